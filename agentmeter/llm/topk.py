"""Exact top-k search by tiled matrix products.

Vectors become integers, floor(scale * x). Queries are dealt to blocks and candidates to shards, and each pair of a block and a shard is a
unit of work: it multiplies tiles of both, keeps the best k of each query from tile to tile (partial selection, then a merge
of two short lists), and returns k rows a query. The lists of units are merged as a tree: first within branches, then over them.

Scale: the plan is the same for any number of queries. Candidates are shuffled once for each block of up to BLOCK queries, and queries
once for each shard of up to SHARD candidates, so a task holds one block and one shard. Nothing passes through the driver
but two counts. The work is queries times candidates by definition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a query block and of a candidate shard at most, about; and rows of both that are multiplied at once.
BLOCK, SHARD = 65_536, 131_072
QUERY_TILE, TILE = 1024, 2048
#: Units whose lists are merged together at the first level of the tree.
FAN_IN = 16
_EXACT = 2.0**53
_LOW, _HIGH = -(2**63), 2**63 - 1
SCHEMA = "query long, query_id long, vec_id long, score long, branch int"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector as doubles; rows with a null id, or with null, empty or non-finite vectors, are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    out = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for any finite x."""
    top, bottom = float(x).as_integer_ratio()
    return top * scale // bottom


def products(a: np.ndarray, b: np.ndarray, scale: int) -> np.ndarray:
    """Integer inner products of the whole vectors of a's and b's rows, exact; what is beyond a long counts as the nearest long.

    Pairs whose products and sums stay below 2 ** 53 are exact as doubles; the others are worked out in whole numbers one by one.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        left, right = np.floor(a * scale), np.floor(b * scale)
        top = np.abs(left).max(axis=1)[:, None] * np.abs(right).max(axis=1)[None, :] * a.shape[1]
        out = left @ right.T
    wide = ~(top < _EXACT)
    if wide.any():
        out[wide] = 0
    out = out.astype(np.int64)
    if wide.any():
        rows, columns = np.flatnonzero(wide.any(axis=1)), np.flatnonzero(wide.any(axis=0))
        mine = {i: [whole(x, scale) for x in a[i]] for i in rows}
        theirs = {j: [whole(x, scale) for x in b[j]] for j in columns}
        for i, j in np.argwhere(wide).tolist():
            out[i, j] = max(_LOW, min(_HIGH, sum(p * q for p, q in zip(mine[i], theirs[j], strict=True))))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, then smaller id; ids of unused places are larger than any other's."""
    n = scores.shape[1]
    if n > 4 * k:  # first all that reach the k-th best score, ties included
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        wide = int((scores >= least[:, None]).sum(axis=1).max())
        if wide < n:
            at = np.argpartition(scores, n - wide, axis=1)[:, n - wide :]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~ turns the order of longs round without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _search(k: int, scale: int):
    unused = np.iinfo(np.int64).max

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and candidates.num_rows:
            asked, given = _matrix(queries["x"]), _matrix(candidates["x"])
            number, name, own = (t[c].to_numpy() for t, c in ((queries, "query"), (queries, "vec_id"), (candidates, "vec_id")))
            for i in range(0, len(asked), QUERY_TILE):
                some = name[i : i + QUERY_TILE]
                scores, ids = np.zeros((len(some), 0), np.int64), np.zeros((len(some), 0), np.int64)
                for j in range(0, len(given), TILE):
                    there = own[j : j + TILE]
                    tile = products(asked[i : i + QUERY_TILE], given[j : j + TILE], scale)
                    same = some[:, None] == there[None, :]  # not the query's own row
                    tile[same] = _LOW
                    s, n = _best(tile, np.where(same, unused, there[None, :]), k)
                    scores, ids = _best(np.hstack([scores, s]), np.hstack([ids, n]), k)
                real = ids < unused
                for column, values in zip(columns, (np.repeat(number[i : i + QUERY_TILE], real.sum(axis=1)), np.repeat(some, real.sum(axis=1)), ids[real], scores[real]), strict=True):
                    column.append(values)
        found = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
        branch = int(candidates["shard"][0].as_py()) // FAN_IN if candidates.num_rows else 0
        return pa.Table.from_arrays([*found, pa.array(np.full(len(found[0]), branch, np.int32))], names=["query", "query_id", "vec_id", "score", "branch"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """Each query's k highest integer inner products over all other rows.

    vectors: vec_id, embedding (array of float or double); other columns are ignored. Queries are the rows whose vec_id is
    divisible by every; candidates all rows but those with the query's own id. Returns query_id, rank (from 1), vec_id
    and score, ties to the smaller vec_id. Rows that usable() leaves out take no part; a query meets candidates of
    its own length only. Repeated rows are separate candidates, but one query; rows of one id with different vectors are
    queries of their own, each with its list. A score beyond a long is the nearest long. An empty table gives no rows.
    """
    rows = usable(vectors).withColumn("dim", F.size("x"))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-vectors.count() // SHARD))
    blocks = max(1, -(-vectors.where(F.col("vec_id") % every == 0).count() // BLOCK))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda n, by: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    number = F.xxhash64("vec_id", "x")
    queries = asked.select(number.alias("query"), "vec_id", "x", "dim", dealt(blocks, number).alias("block"), each(shards, "shard"))
    candidates = rows.select("vec_id", "x", "dim", dealt(shards, F.monotonically_increasing_id()).alias("shard"), each(blocks, "block"))
    units = queries.groupBy("dim", "block", "shard").cogroup(candidates.groupBy("dim", "block", "shard"))
    lists = units.applyInArrow(_search(k, scale), SCHEMA)
    for keys in (["query_id", "query", "branch"], ["query_id", "query"]):
        lists = lists.withColumn("rank", F.row_number().over(_order(keys))).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")


def _order(keys: list[str]) -> Column:
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")


ORACLE = """
WITH whole AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.embedding AS query, c.vec_id,
         CAST(greatest(-9223372036854775808::HUGEINT, least(9223372036854775807::HUGEINT,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS HUGEINT))) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, embedding, v FROM whole WHERE vec_id % 100 = 0) q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
