"""Named queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agentmeter import fixtures
from agentmeter.functions import dims

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Named pieces of SQL that the texts below share; each may use those before it.
PIECES: dict[str, str] = dict(fixtures.SQL)
PIECES["prices"] = dims.values_sql(dims.price_rows(), dims.PRICE_COLUMNS)
PIECES["ends"] = dims.values_sql(dims.end_rows(), dims.END_COLUMNS)
PIECES["corners"] = dims.values_sql(dims.corner_rows(), dims.CORNER_COLUMNS)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is a SELECT over the driver's tables and PIECES."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {pieces(sql)} {sql}" if pieces(sql) else sql
        return f

    return keep


def pieces(sql: str) -> str:
    """The pieces that sql names, and those that they name, in order."""
    import re

    words = lambda text: set(re.findall(r"\w+", text))
    needed: set[str] = set()
    todo = words(sql) & PIECES.keys()
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= (words(PIECES[name]) & PIECES.keys()) - needed
    return ", ".join(f"{name} AS ({text})" for name, text in PIECES.items() if name in needed)
