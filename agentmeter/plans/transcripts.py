"""Queries on transcripts: conversations and requests seen as what agents did."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.functions import text as tx
from agentmeter.operators import transcripts as tr
from agentmeter.plans.registry import query
from agentmeter.sources.other_logs import upload_files


@query("o_a25_delegation", """SELECT conv_id AS run, count(*) FILTER (turn % 4 = 0) AS delegations, count(*) FILTER (turn % 4 IN (1, 3)) AS main_edits, count(*) FILTER (turn % 4 = 1) AS main_code_edits, count(*) FILTER (turn % 4 = 2) AS worker_edits,
    coalesce(string_agg('tests/test_' || turn || '.py', ',' ORDER BY 'tests/test_' || turn || '.py') FILTER (turn % 4 = 3), '') AS test_files,
    coalesce(string_agg(CASE WHEN turn % 8 = 0 THEN 'completed' ELSE 'none' END, ',' ORDER BY turn) FILTER (turn % 4 = 0), '') AS reports FROM conversations GROUP BY conv_id""")
def o_a25(spark, sf_dir):
    """Turns as tool uses: hand-offs, edits by either side; every other hand-off reports back. Each is logged twice."""
    c = fx.table(spark, sf_dir, "conversations")
    t, kind = F.col("turn"), F.col("turn") % 4
    ident = F.concat(F.lit("t"), t.cast("string"))
    none = F.lit(None).cast("string")
    use = c.select(
        F.col("conv_id").alias("run"), t.alias("ts"), ident.alias("id"), F.lit("tool_use").alias("type"), F.when(kind == 0, "Task").otherwise("Edit").alias("name"),
        F.when(kind == 3, F.concat(F.lit("tests/test_"), t.cast("string"), F.lit(".py"))).otherwise("src/a.py").alias("path"), (kind == 2).alias("is_sidechain"), none.alias("tool_use_id"), none.alias("text"),
    )
    back = c.where("turn % 8 = 0").select(F.col("conv_id").alias("run"), t.alias("ts"), none.alias("id"), F.lit("tool_result").alias("type"), none.alias("name"), none.alias("path"), F.lit(False).alias("is_sidechain"), ident.alias("tool_use_id"), F.concat("text", F.lit("\nOutcome: completed")).alias("text"))
    d = tr.delegation(use.union(use).union(back))
    return d.withColumns({"test_files": F.array_join("test_files", ","), "reports": F.array_join("reports", ",")})


@query("o_j22_changed_files", """SELECT session_id AS run, request_id AS step, f AS file, CASE WHEN f = 'a' THEN 'changed' ELSE 'deleted' END AS change FROM requests CROSS JOIN (VALUES ('a'), ('b')) t(f) WHERE (f = 'a' AND k % 3 = 0) OR (f = 'b' AND k % 5 = 0)""")
def o_j22(spark, sf_dir):
    """A snapshot before and after each request: file a may change, b may go, c is new and so doesn't count."""
    r = fx.requests(spark, sf_dir)
    k = F.col("k")
    files = lambda a, b: F.map_filter(F.create_map(F.lit("a"), a, F.lit("b"), b, F.lit("c"), F.lit(None).cast("string")), lambda n, h: h.isNotNull())
    one = lambda moment, at, a, b: r.select(F.col("session_id").alias("run"), F.when(k % 2 == 0, F.col("request_id")).alias("handoff"), at.alias("at"), F.lit(moment).alias("moment"), files(a, b).alias("files"))
    stamp = F.unix_micros("ts")
    before = one("before", stamp * 2, F.lit("1"), F.lit("1"))
    after = one("after", stamp * 2 + 1, F.when(k % 3 == 0, "2").otherwise("1"), F.when(k % 5 != 0, "1"))
    steps = r.select(F.col("session_id").alias("run"), (stamp * 2 + 1).alias("at"), "request_id")
    found = tr.changed_files(before.union(after)).withColumnRenamed("step", "at")
    return found.join(steps, ["run", "at"]).select("run", F.col("request_id").alias("step"), "file", "change")


@query("o_p32_missing_names", "SELECT p_partkey AS key, 'need_' || (p_partkey % 7) AS name FROM part WHERE p_size % 3 <> 0")
def o_p32(spark, sf_dir):
    """A source and a test file for each part, in Python or script: the test imports one name that some sources define."""
    p = fx.table(spark, sf_dir, "part")
    name = F.concat(F.lit("need_"), (F.col("p_partkey") % 7).cast("string"))
    python = F.col("p_partkey") % 2 == 0
    there = F.col("p_size") % 3 == 0
    source = F.when(python, F.concat(F.lit("x = 1\ndef other():\n    pass\n"), F.when(there, F.concat(F.lit("def "), name, F.lit("(a):\n    return a\n"))).otherwise(""))).otherwise(F.concat(F.lit("export const other = 1;\n"), F.when(there, F.concat(F.lit("export async function "), name, F.lit("() {}\n"))).otherwise("")))
    test = F.when(python, F.concat(F.lit("from lib import other, "), name, F.lit(" as n\n"))).otherwise(F.concat(F.lit("import { other, "), name, F.lit(" as n } from './lib';\n")))
    files = lambda path, script, text: p.select(F.col("p_partkey").alias("key"), F.when(python, path).otherwise(script).alias("path"), text.alias("text"))
    return tr.missing_names(files("lib.py", "lib.ts", source).union(files("tests/test_lib.py", "lib.test.ts", test))).select("key", "name")


@query("o_s9_upload_scan", "SELECT 's' || (o_custkey % 12) AS submitter, sha256('{\"order\":' || o_orderkey || '}') AS sha256, true AS named_by_hash, o_orderkey AS order_no FROM orders")
def o_s9(spark, sf_dir):
    """Uploads as (path, content) rows, as the scan of files gives them."""
    o = fx.table(spark, sf_dir, "orders")
    text = F.to_json(F.struct(F.col("o_orderkey").alias("order")))
    rows = o.select(F.concat(F.lit("records/s"), (F.col("o_custkey") % 12).cast("string"), F.lit("/"), F.sha2(text.cast("binary"), 256), F.lit(".json")).alias("path"), text.cast("binary").alias("content"))
    found = upload_files(rows)
    return found.select("submitter", "sha256", (F.col("file_name") == F.col("sha256")).alias("named_by_hash"), F.get_json_object("text", "$.order").cast("long").alias("order_no"))


@query("o_p1_parse_ts", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS ts FROM events")
def o_p1(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = F.when(F.col("event_id") % 10 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select("event_id", tx.parse_ts(text).alias("ts"))
