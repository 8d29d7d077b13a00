"""Queries on the live stream, and on windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.functions import dims
from agentmeter.operators import requests as rq
from agentmeter.plans.attribution import World
from agentmeter.plans.registry import PIECES, query
from agentmeter.plans.rollup import stated
from agentmeter.sources import shared
from agentmeter.streaming import live

PARTS = 3


#: The fixture's people are its sessions and pause for weeks; no state is dropped within its months.
IDLE_MINUTES = 400 * 24 * 60


def final(spark, sf_dir, run=live.run_to_table):
    """The stream of raw rows and commits, in files by time, run to its end. Each commit is seen by a hook, and up to 99 s later in the log."""
    priced = rq.priced(fx.raw_request_rows(spark, sf_dir), dims.prices(spark))
    rows = priced.select("session_id", "ts", F.lit("request").alias("kind"), "request_id", "output", F.coalesce("nano_usd", F.lit(0)).alias("nano_usd"), rq.ctx_len().alias("ctx"), "is_sidechain")
    seen = F.explode(F.array(F.col("ts"), F.timestamp_seconds(F.unix_seconds("ts") + F.col("k")))).alias("ts")
    commits = fx.commits(spark, sf_dir).select(F.col("author").alias("session_id"), seen, F.lit("commit").alias("kind"))
    both = rows.unionByName(commits, allowMissingColumns=True)
    both = both.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in live.ROWS.split(", ")])
    top = shared.folder(spark, "live")
    stamp = F.unix_micros("ts")
    first, last = both.agg(F.min(stamp), F.max(stamp)).first()
    for i in range(PARTS):  # the log grows, and the stream goes on from its checkpoint each time
        lo, hi = first + (last - first) * i // PARTS, first + (last - first) * (i + 1) // PARTS
        both.where((stamp >= lo) & ((stamp < hi) if i < PARTS - 1 else F.lit(True))).write.mode("append").parquet(f"{top}/in")
        table = run(live.live_states(live.tail(spark, f"{top}/in"), IDLE_MINUTES), f"{top}/out", f"{top}/check")
    return table


PIECES["sightings"] = "SELECT author AS session_id, ts FROM commits UNION SELECT author, ts + to_seconds(k) FROM commits"
PIECES["announced"] = """SELECT session_id, min(ts) AS ts FROM sightings GROUP BY session_id
    UNION ALL SELECT a.session_id, min(s.ts) FROM announced a JOIN sightings s ON s.session_id = a.session_id AND s.ts > a.ts + INTERVAL 120 SECOND GROUP BY a.session_id"""
PIECES["live_last"] = "SELECT session_id, max(ts) AS commit_ts, count(*) AS n FROM announced GROUP BY session_id"
PIECES["live_open"] = "SELECT r.*, l.n, l.commit_ts FROM measured r LEFT JOIN live_last l ON l.session_id = r.session_id"
PIECES["live_state"] = """SELECT s.session_id, CAST(coalesce(sum(nano_usd) FILTER (commit_ts IS NULL OR ts > commit_ts), 0) AS BIGINT) AS task_nano_usd, CAST(count(*) FILTER (commit_ts IS NULL OR ts > commit_ts) AS INTEGER) AS task_requests, CAST(coalesce(max(n), 0) AS INTEGER) AS commits,
    CAST(coalesce(arg_min(fresh_in + cache_write + cache_read, {'t': ts, 'r': request_id}) FILTER (NOT is_sidechain AND fresh_in + cache_write + cache_read > 0), 0) AS BIGINT) AS base_ctx, CAST(coalesce(arg_max(fresh_in + cache_write + cache_read, {'t': ts, 'r': request_id}) FILTER (NOT is_sidechain), 0) AS BIGINT) AS last_ctx,
    CAST(coalesce(arg_min(fresh_in + cache_write + cache_read, {'t': ts, 'r': request_id}) FILTER (NOT is_sidechain AND ts > commit_ts AND fresh_in + cache_write + cache_read > 0), 0) AS BIGINT) AS after
    FROM (SELECT session_id FROM requests UNION SELECT author FROM commits) s LEFT JOIN live_open o ON o.session_id = s.session_id GROUP BY s.session_id"""


@query("o_x2_live_state", "SELECT session_id, task_nano_usd, task_requests, commits, base_ctx, last_ctx, CASE WHEN commits > 0 THEN greatest(0, after - base_ctx) ELSE 0 END AS carried FROM live_state")
def o_x2(spark, sf_dir):
    return live.latest(final(spark, sf_dir)).drop("announced")


PIECES["usual"] = "SELECT CAST(round(median(usd) * 1000000000) AS BIGINT) AS usual FROM (SELECT *, count(*) FILTER (status LIKE 'kept%') OVER () >= 5 AS enough FROM stated WHERE seen > 0) WHERE NOT enough OR status LIKE 'kept%'"
PIECES["live_share"] = "SELECT *, least(1.0, CASE WHEN last_ctx > 0 AND commits > 0 THEN greatest(0, after - base_ctx) / last_ctx ELSE 0 END) AS share FROM live_state CROSS JOIN usual"


@query(
    "o_x3_status",
    """SELECT session_id, task_nano_usd,
      CASE WHEN task_nano_usd > 3.0::DOUBLE * usual THEN 'red' WHEN task_nano_usd > 1.5::DOUBLE * usual THEN 'amber' ELSE 'plain' END AS colour,
      CASE WHEN share >= 0.05 THEN CAST(round_even(share * 100, 0) AS INTEGER) END AS carried_percent
    FROM live_share""",
)
def o_x3(spark, sf_dir):
    """Each batch's states against the baseline, which the first batch finds absent and computes from the receipts."""
    baselines = shared.folder(spark, "baselines")
    refresh = lambda: stated(World(spark, sf_dir))
    table = final(spark, sf_dir, lambda states, path, checkpoint: live.run_status(states, path, checkpoint, baselines, refresh))
    return live.latest(table)


@query("o_x4_announcements", "SELECT session_id, ts AS commit_ts FROM announced")
def o_x4(spark, sf_dir):
    return live.announcements(final(spark, sf_dir))


@query("o_x8_bursts", "SELECT session_id, count(*) AS requests, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, request_id) AS b FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, request_id)) >= 7200000000 AS gap FROM requests)) GROUP BY session_id, b")
def o_x8(spark, sf_dir):
    return live.bursts(fx.requests(spark, sf_dir))


@query("o_x8_spend_by_hour", "SELECT date_trunc('hour', ts) AS start_ts, CAST(sum(nano_usd) AS BIGINT) AS nano_usd, count(*) AS requests FROM measured GROUP BY 1")
def o_x8h(spark, sf_dir):
    return live.spend(rq.priced(fx.requests(spark, sf_dir), dims.prices(spark)), "1 hour")


@query("o_x8_spend_by_five_hours", "SELECT start_ts, CAST(sum(nano_usd) AS BIGINT) AS nano_usd, count(*) AS requests FROM (SELECT date_trunc('hour', ts) - to_hours(CAST(h AS INTEGER)) AS start_ts, nano_usd FROM measured CROSS JOIN range(5) t(h)) GROUP BY start_ts")
def o_x8s(spark, sf_dir):
    return live.spend(rq.priced(fx.requests(spark, sf_dir), dims.prices(spark)), "5 hours", "1 hour")
