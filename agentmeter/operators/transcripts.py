"""What agents did in transcripts: delegations and edits, hook snapshots, and the names that hidden tests need."""

from __future__ import annotations

import ast
import symtable
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.functions import text as tx

# Tools that hand work to another agent.
DELEGATE_TOOLS = ("Agent", "Task")
# Endings that a script module's name may leave out, the first that fits first, and how scripts import and export.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js")
SCRIPT = r"\.([jt]sx?|mjs)$"
SCRIPT_IMPORT = r"import\s*\{([^}]*)\}\s*from\s*['\"](\.{1,2}/[^'\"]+)['\"]"
SCRIPT_EXPORT = (
    r"export\s+(?:(?:default|declare)\s+)*(?:(?:async\s+)?function\s*\*?|(?:abstract\s+)?class|(?:const\s+)?enum|const|let|var|type|interface|namespace|\*\s+as)\s+([\w$]+)"
)
SCRIPT_LIST = r"export\s*\{([^}]*)\}"


def delegation(blocks: DataFrame) -> DataFrame:
    """By run: delegations, edits by side, edits of code by the main agent, the test files it wrote, and the workers' reports in order.

    blocks: run, ts, id, type, name, path, is_sidechain, tool_use_id, text. A block id counts once; a report that never came is 'none'.
    """
    use = blocks.where("type = 'tool_use'").groupBy("run", "id").agg(F.min_by(F.struct("ts", "name", "path", "is_sidechain"), "ts").alias("u")).select("run", "id", "u.*")
    handed, edit, test = F.col("name").isin(*DELEGATE_TOOLS) & ~F.col("is_sidechain"), F.col("name").isin(*tx.EDIT_TOOLS), F.coalesce(F.col("path").rlike(tx.TEST_FILE), F.lit(False))
    main = ~F.col("is_sidechain")
    counts = use.groupBy("run").agg(
        F.count_if(handed).alias("delegations"), F.count_if(edit & main).alias("main_edits"), F.count_if(edit & main & ~test).alias("main_code_edits"), F.count_if(edit & ~main).alias("worker_edits"),
        F.array_sort(F.collect_set(F.when(edit & main & test, F.col("path")))).alias("test_files"),
    )
    results = blocks.where("type = 'tool_result' AND NOT is_sidechain").groupBy("run", F.col("tool_use_id").alias("id")).agg(F.max_by(tx.worker_outcome(F.col("text")), "ts").alias("report"))
    told = use.where(handed).join(results, ["run", "id"], "left").groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", F.coalesce("report", F.lit("none")).alias("report")))), lambda x: x["report"]).alias("reports"))
    return counts.join(told, "run", "left").withColumn("reports", F.coalesce("reports", F.array().cast("array<string>")))


def changed_files(snapshots: DataFrame) -> DataFrame:
    """(run, step, file, change): files that were there before a hand-off and that it changed or deleted.

    snapshots: run, handoff (null if the hook didn't say), at, moment ('before' or 'after'), files (map of name to hash). An after
    snapshot meets the before one of its hand-off, else the latest before it.
    """
    order = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.when(F.col("moment") == "before", F.col("files"))
    s = snapshots.withColumn("latest", F.last(before, ignorenulls=True).over(order))
    named = snapshots.where("moment = 'before' AND handoff IS NOT NULL").select("run", "handoff", F.col("files").alias("own"))
    pairs = s.where("moment = 'after'").join(named, ["run", "handoff"], "left").withColumn("was", F.coalesce("own", "latest")).where("was IS NOT NULL")
    each = pairs.select("run", F.col("at").alias("step"), "files", F.explode("was").alias("file", "hash"))
    now = F.try_element_at("files", F.col("file"))
    return each.select("run", "step", "file", F.when(now.isNull(), "deleted").when(now != F.col("hash"), "changed").alias("change")).where("change IS NOT NULL")


def _bound(text: str, path: str) -> set[str] | None:
    """The names a Python source binds at its top level, branches included; None if it can't be read."""
    try:
        top = symtable.symtable(text, path, "exec")
    except (SyntaxError, ValueError):
        return None
    return {s.get_name() for s in top.get_symbols() if s.is_assigned() or s.is_imported() or s.is_namespace()}


def _asked(text: str) -> set[tuple[str, str, str]]:
    """(role, module, name) of what a Python test takes from absolute modules: 'import' for names it imports, 'use' for attributes of modules.

    A name imported from a package may be a module itself, so its attributes are uses too; whether it is one the files decide.
    """
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError):
        return set()
    taken = [(n.module, a) for n in nodes if isinstance(n, ast.ImportFrom) and n.module and not n.level for a in n.names if a.name != "*"]
    whole = [a for n in nodes if isinstance(n, ast.Import) for a in n.names]
    stands_for = {a.asname or a.name: {f"{module}.{a.name}"} for module, a in taken}
    for a in whole:
        stands_for.setdefault(a.asname or a.name, set()).add(a.name)
    used = {(module, n.attr) for n in nodes if isinstance(n, ast.Attribute) for module in stands_for.get(ast.unparse(n.value) if isinstance(n.value, ast.Name | ast.Attribute) else "", ())}
    return {("import", module, a.name) for module, a in taken} | {("use", module, name) for module, name in used}


def _python_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, path, text, is_test in zip(pdf["key"], pdf["path"], pdf["text"], pdf["is_test"], strict=True):
            if is_test:
                out += [(key, role, module, None, name) for role, module, name in sorted(_asked(text or ""))]
                continue
            names = _bound(text or "", path)
            out += [(key, "unread", None, path, None)] if names is None else [(key, "bound", None, path, name) for name in sorted(names)]
        yield pd.DataFrame(out, columns=["key", "role", "module", "path", "name"])


def _modules(files: DataFrame) -> DataFrame:
    """(key, module, path) of Python files by the names they are imported by, from the top folder or src; a plain file goes before a package."""
    bare = F.regexp_replace("path", r"^src/", "")
    module = F.translate(F.regexp_replace(bare, r"(/__init__)?\.py$", ""), "/", ".")
    rank = F.struct(F.col("path").startswith("src/"), F.col("path").endswith("/__init__.py"))
    return files.where(F.col("path").endswith(".py")).groupBy("key", module.alias("module")).agg(F.min_by("path", rank).alias("path"))


def _resolved(folder: Column, relative: Column) -> Column:
    """The path that a relative one names in a folder, its . and .. worked off."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda x: ~x.isin("", "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))), "/")


def _script_names(files: DataFrame, known: DataFrame) -> DataFrame:
    """(key, path, name) that script tests import from relative modules among known (key, path) and that files (is_test) don't export."""
    script = files.where(F.col("path").rlike(SCRIPT))
    found = [F.regexp_extract_all("text", F.lit(SCRIPT_IMPORT), i) for i in (1, 2)]
    imports = script.where("is_test").select("key", "path", F.explode(F.arrays_zip(found[0].alias("names"), found[1].alias("source"))).alias("i"))
    base = _resolved(F.regexp_replace("path", r"[^/]*$", ""), F.col("i.source"))
    name = F.regexp_extract(F.trim("raw"), r"^(?:type\s+(?!as\b))?([\w$]+)", 1)
    asked = imports.select("key", base.alias("base"), F.explode(F.split("i.names", ",")).alias("raw")).select("key", "base", name.alias("name")).where("name NOT IN ('', 'type')")
    bare = lambda ending: F.col("path").substr(F.lit(1), F.length("path") - len(ending))
    called = F.array_compact(F.array(*[F.when(F.col("path").endswith(e), F.struct(bare(e).alias("base"), F.lit(n).alias("rank"))) for n, e in enumerate(SCRIPT_ENDINGS)]))
    modules = known.select("key", "path", F.explode(called).alias("c")).groupBy("key", "c.base").agg(F.min_by("path", "c.rank").alias("path"))
    lists = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SCRIPT_LIST), 1), lambda x: F.regexp_extract_all(x, F.lit(r"([\w$]+)"), 1)))
    exported = script.where("NOT is_test").select("key", "path", F.explode(F.concat(F.regexp_extract_all("text", F.lit(SCRIPT_EXPORT), 1), lists)).alias("name"))
    return asked.join(modules, ["key", "base"]).select("key", "path", "name").distinct().join(exported, ["key", "path", "name"], "left_anti")


def missing_names(files: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """(key, path, name): names that a task's test files take from its modules and that its other files don't define.

    files: key, path, text, as they were before the commit but for the test files; added: (key, path) of files that the commit adds. Names are
    imported from a module, or used as attributes of an imported one. Modules that aren't among the files are others' and ask for
    nothing; nor does a module that can't be read. Python is read by its own parser; script files by patterns, without Python.
    """
    f = files.withColumn("is_test", F.col("path").rlike(tx.TEST_FILE))
    key = files.schema["key"].dataType.simpleString()
    facts = f.where(F.col("path").endswith(".py")).select("key", "path", "text", "is_test").mapInPandas(_python_names, f"key {key}, role string, module string, path string, name string")
    known = f.where("NOT is_test").select("key", "path")
    known = known if added is None else known.unionByName(added.select("key", "path")).distinct()
    modules = _modules(known)
    asked = facts.where("role IN ('import', 'use')").drop("path").join(modules, ["key", "module"])
    itself = modules.select("key", F.col("module").alias("whole"))  # an imported name that is a module
    whole = F.when(F.col("role") == "import", F.concat_ws(".", "module", "name"))
    wanted = asked.withColumn("whole", whole).join(itself, ["key", "whole"], "left_anti").select("key", "path", "name").distinct()
    unread, bound = (facts.where(F.col("role") == role) for role in ("unread", "bound"))
    python = wanted.join(unread.select("key", "path"), ["key", "path"], "left_anti").join(bound.select("key", "path", "name"), ["key", "path", "name"], "left_anti")
    return python.select("key", "path", "name").unionByName(_script_names(f, known))
