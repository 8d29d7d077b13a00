"""Queries on single steps of the log, price and stream jobs."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.functions import dims
from agentmeter.functions import text as tx
from agentmeter.operators import requests as rq
from agentmeter.operators import stats
from agentmeter.plans import live as live_plans
from agentmeter.plans.attribution import World
from agentmeter.plans.logs import log_lines, rollout_lines, talk
from agentmeter.plans.registry import query
from agentmeter.plans.rollup import rounded, stated
from agentmeter.plans.runs import sums
from agentmeter.sources import other_logs, session_logs
from agentmeter.streaming import live


@query("o_p2_usage_mapping", "SELECT CASE WHEN k % 4 = 0 THEN session_id || ':m' || request_id ELSE CAST(request_id AS VARCHAR) END AS request_id, file_path, fresh_in, cache_write, cache_read, output, least(cache_write_1h, cache_write) AS cache_write_1h FROM log_kinds WHERE kind = 'usage'")
def o_p2(spark, sf_dir):
    r = session_logs.request_rows(session_logs.parsed(log_lines(spark, sf_dir)))
    return r.select("request_id", "file_path", "fresh_in", "cache_write", "cache_read", "output", "cache_write_1h")


@query("o_p3_rollout_usage", "SELECT 'rollout:' || user_id AS session_id, ts, 39 * k AS fresh_in, k AS cache_write, 60 * k AS cache_read, 5 * k + 2 AS output FROM ev WHERE event_type = 'view'")
def o_p3(spark, sf_dir):
    r = other_logs.rollout_usage(other_logs.rollout_rows(rollout_lines(spark, sf_dir)))
    return r.select("session_id", "ts", "fresh_in", "cache_write", "cache_read", "output")


@query("o_p4_model_names", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'claude-sonnet-' || (o_orderkey % 9) || '-' || (o_orderkey % 7) WHEN 1 THEN 'claude-opus-' || (o_orderkey % 9) WHEN 2 THEN 'claude-x-5' ELSE 'other-1.0' END AS model FROM orders")
def o_p4(spark, sf_dir):
    k = F.col("o_orderkey")
    digit = lambda n: (k % n).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("claude-"), digit(9), F.lit("."), digit(7), F.lit("-sonnet-high"))).when(k % 4 == 1, F.concat(F.lit("claude-"), digit(9), F.lit("-opus"))).when(k % 4 == 2, "claude-x.5").otherwise("other-1.0")
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", tx.normal_model(name).alias("model"))


@query("o_p5_request_keys", "SELECT request_id, CASE WHEN k % 3 = 0 THEN CAST(request_id AS VARCHAR) WHEN k % 3 = 1 THEN session_id || ':m' || k END AS key FROM requests")
def o_p5(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    k = F.col("k")
    return fx.requests(spark, sf_dir).select("request_id", tx.request_key(F.when(k % 3 == 0, text("request_id")), text("session_id"), F.when(k % 3 == 1, F.concat(F.lit("m"), text("k")))).alias("key"))


@query("o_p6_prefiltered_lines", "SELECT count(*) AS lines, count(*) FILTER (kind <> 'corrupt') AS useful FROM (SELECT kind FROM log_kinds UNION ALL SELECT 'result' FROM requests WHERE k % 5 <> 0)")
def o_p6(spark, sf_dir):
    rows = session_logs.parsed(log_lines(spark, sf_dir))
    return rows.agg(F.count("*").alias("lines"), F.count_if((F.col("kind") != "corrupt") & F.col("r").isNotNull()).alias("useful"))


@query("o_p7_synthetic_rows", "SELECT file_path, count(*) FILTER (kind = 'synthetic') AS synthetic, count(*) FILTER (kind = 'usage') AS kept FROM log_kinds GROUP BY file_path")
def o_p7(spark, sf_dir):
    rows = session_logs.parsed(log_lines(spark, sf_dir))
    return rows.groupBy("file_path").agg(F.count_if(F.col("kind") == "synthetic").alias("synthetic"), F.count_if(F.col("kind") == "usage").alias("kept"))


@query("o_p10_edit_targets", "SELECT DISTINCT CAST(session_id AS VARCHAR) AS session_id, 'f' || k AS path FROM requests WHERE k % 7 = 0 AND request_id % 50 <> 0")
def o_p10(spark, sf_dir):
    b = session_logs.blocks(session_logs.parsed(log_lines(spark, sf_dir)))
    return b.select("session_id", tx.edit_target(F.col("name"), F.col("input.file_path"), F.col("input.notebook_path")).alias("path")).where("path IS NOT NULL").distinct()


@query("o_p16_joules", "SELECT request_id, round((fresh_in + cache_write) * e_pre_high + cache_read * e_kv_high + output * (e_dec_high + e_ctx_high * (fresh_in + cache_write + cache_read)), 5) AS joules FROM requests JOIN model_class USING (model) JOIN ends USING (class)")
def o_p16(spark, sf_dir):
    r = fx.requests(spark, sf_dir).withColumn("class", rq.model_class(F.col("model"))).join(F.broadcast(dims.ends(spark)), "class")
    return r.select("request_id", F.round(rq.joules(*[F.col(f"{c}_high") for c in ("e_pre", "e_dec", "e_ctx", "e_kv")]), 5).alias("joules"))


@query("o_p24_worker_outcomes", "SELECT CASE conv_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'blocked' ELSE 'none' END AS outcome, count(*) AS n FROM talk WHERE said IS NOT NULL GROUP BY 1")
def o_p24(spark, sf_dir):
    return talk(spark, sf_dir).where("said IS NOT NULL").groupBy(tx.worker_outcome(F.col("said")).alias("outcome")).agg(F.count("*").alias("n"))


@query("o_w3_sticky_fields", "SELECT 'u' || user_id AS file_path, ts, '/w/' || user_id AS cwd, last_value(CASE WHEN event_type = 'click' THEN 'm' || (k % 3) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM ev WHERE event_type IN ('view', 'click')")
def o_w3(spark, sf_dir):
    rows = other_logs.rollout_rows(rollout_lines(spark, sf_dir))
    return rows.where("type IN ('event_msg', 'turn_context')").select("file_path", "ts", "cwd", "model")


@query("o_w15_running_maximum", "SELECT id, round(max(step) OVER (ORDER BY p, id), 9) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) * p) AS step FROM (SELECT id || '/' || repo AS id, (count(*) % 50) / 1000 AS p FROM sums GROUP BY sums.id, repo))")
def o_w15(spark, sf_dir):
    n = sums(spark, sf_dir).groupBy("id", "repo").agg(F.count("*").alias("n"))
    t = n.select(F.concat_ws("/", "id", F.col("repo").cast("string")).alias("id"), ((F.col("n") % 50) / 1000).alias("p"), F.lit(8).alias("repos"), F.lit(8).alias("direction"))
    return rounded(stats.holm(t).select("id", "p_holm"), 9, "p_holm")


@query("o_t4_top_per_repo", "SELECT repo, sha, rank FROM (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY round(usd, 9) DESC, sha) AS rank FROM receipts WHERE seen > 0) WHERE rank <= 3")
def o_t4(spark, sf_dir):
    order = Window.partitionBy("repo").orderBy(F.round("usd", 9).desc(), "sha")
    worked = World(spark, sf_dir).receipt().where("seen > 0")
    return worked.select("repo", "sha", F.row_number().over(order).cast("long").alias("rank")).where("rank <= 3")


@query("o_x1_incremental_tail", "SELECT session_id, 'commits' AS kind, count(*) AS n FROM announced GROUP BY session_id")
def o_x1(spark, sf_dir):
    """Files read batch by batch: every commit of every session is seen once."""
    table = live_plans.final(spark, sf_dir)
    return table.groupBy("session_id").agg(F.sum(F.size("announced")).alias("n")).where("n > 0").select("session_id", F.lit("commits").alias("kind"), "n")


@query("o_x5_baseline", "SELECT round(median(usd), 8) AS usd, count(*) AS commits FROM stated WHERE seen > 0 AND status LIKE 'kept%'")
def o_x5(spark, sf_dir):
    """The table of baselines, with its one row read back."""
    from agentmeter.sources import shared

    path = shared.folder(spark, "baselines")
    live.write_baseline(stated(World(spark, sf_dir)), path, datetime.now(UTC))
    return rounded(spark.read.parquet(path).select("usd", "commits"), 8, "usd")


@query("o_x6_ledger_stream", "SELECT repo, sha, CASE WHEN sha % 3 = 0 THEN k ELSE k + 1 END AS requests FROM commits")
def o_x6(spark, sf_dir):
    """A stream of receipts into the ledger, stopped and started again: the second time each has one more request, but a third of them one fewer."""
    from agentmeter.sources import shared

    c = fx.commits(spark, sf_dir)
    receipts = lambda n: c.select("repo", "sha", n.alias("requests"), (n + 1).alias("seen_requests"), F.lit(0.5).alias("usd"), F.lit(1).alias("first_seen"))
    top = shared.folder(spark, "ledger")
    for n in (F.col("k"), F.when(F.col("sha") % 3 == 0, F.col("k") - 1).otherwise(F.col("k") + 1)):
        rows = receipts(n).unionByName(receipts(n - 2))  # two states of each in one batch
        rows.write.mode("append").parquet(f"{top}/in")
        ledger = live.run_ledger(spark.readStream.schema(rows.schema).parquet(f"{top}/in"), f"{top}/ledger", f"{top}/check")
    return ledger.select("repo", "sha", "requests")


@query(
    "o_x7_late_rows",
    """SELECT session_id, count(*) FILTER (late) AS late, count(*) AS n
    FROM (SELECT session_id, coalesce(ts < max(ts) OVER (PARTITION BY session_id ORDER BY came ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 120 MINUTE, false) AS late
      FROM (SELECT *, request_id * 7919 % 10007 * 1000000 + request_id AS came FROM requests))
    GROUP BY session_id""",
)
def o_x7(spark, sf_dir):
    """Requests as they come, in another order than that of their times and in three batches; late ones go to a table of their own."""
    from agentmeter.sources import shared

    came = F.col("request_id") * 7919 % 10007 * 1_000_000 + F.col("request_id")
    rows = fx.requests(spark, sf_dir).select("session_id", came.alias("came"), "ts", F.timestamp_micros(came + 86_400_000_000).alias("arrived"))
    top = shared.folder(spark, "late")
    for i in range(3):
        later = F.col("came") >= (i + 1) * 3336 * 1_000_000 if i < 2 else F.lit(False)  # the last has all that is left, whatever the ids
        rows.where((F.col("came") >= i * 3336 * 1_000_000) & ~later).write.mode("append").parquet(f"{top}/in")
        timely, late = live.run_late(live.late_split(spark.readStream.schema(rows.schema).parquet(f"{top}/in")), f"{top}/out", f"{top}/check")
    both = timely.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.lit(1)))
    return both.groupBy("session_id").agg(F.sum("late").cast("long").alias("late"), F.count("*").alias("n"))
