"""Queries that roll receipts up."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.functions import dims
from agentmeter.operators import rollup, savings
from agentmeter.plans.attribution import World
from agentmeter.plans.registry import PIECES, query
from agentmeter.plans.requests import measured

# Receipts with a status, which stands for the kept cascade where commits come from events.
PIECES["stated"] = "SELECT *, CASE sha % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'kept (squash)' WHEN 2 THEN 'discarded' ELSE 'pending' END AS status FROM receipts"
PIECES["noted"] = """SELECT r.repo, r.sha, c.ts, c.author, CAST(c.k * 100 + 1 AS BIGINT) AS cents, r.wh_low, r.wh_high,
    CASE WHEN r.sha % 5 = 0 THEN 'durable' WHEN r.sha % 5 = 1 THEN 'reverted' WHEN r.sha % 5 = 2 THEN 'too new' ELSE 'not kept' END AS outcome FROM receipts r JOIN commits c ON r.repo = c.repo AND r.sha = c.sha"""
_WEEK = "strftime(ts, '%G-W%V')"


def stated(w):
    status = F.when(F.col("sha") % 4 == 0, "kept").when(F.col("sha") % 4 == 1, "kept (squash)").when(F.col("sha") % 4 == 2, "discarded").otherwise("pending")
    return w.receipt().withColumn("status", status)


def noted(w):
    outcome = F.when(F.col("sha") % 5 == 0, "durable").when(F.col("sha") % 5 == 1, "reverted").when(F.col("sha") % 5 == 2, "too new").otherwise("not kept")
    c = w.commits.select("repo", "sha", "ts", "author", (F.col("k") * 100 + 1).alias("cents"))
    return w.receipt().join(c, ["repo", "sha"]).select("repo", "sha", "ts", "author", "cents", "wh_low", "wh_high", outcome.alias("outcome"))


def rounded(df, n, *columns):
    return df.select(*[F.round(c, n).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("o_a5_typical_commit", "SELECT round(median(wh_low), 7) AS wh_low, round(median(wh_high), 7) AS wh_high, round(median(usd), 8) AS usd, count(*) AS commits FROM stated WHERE seen > 0 AND (status LIKE 'kept%' OR (SELECT count(*) FROM stated WHERE seen > 0 AND status LIKE 'kept%') < 5)")
def o_a5(spark, sf_dir):
    return rounded(rounded(rollup.typical(stated(World(spark, sf_dir))), 7, "wh_low", "wh_high"), 8, "usd")


@query("o_a6_discarded_share", "SELECT round(sqrt(sum(CASE WHEN status = 'discarded' THEN wh_low + lead_up_wh_low ELSE 0 END) * sum(CASE WHEN status = 'discarded' THEN wh_high + lead_up_wh_high ELSE 0 END)) / sqrt(sum(wh_low + lead_up_wh_low) * sum(wh_high + lead_up_wh_high)), 6) AS share FROM stated WHERE status <> 'pending'")
def o_a6(spark, sf_dir):
    return rounded(rollup.discarded_share(stated(World(spark, sf_dir))), 6, "share")


PIECES["new_ledger"] = "SELECT repo, sha, requests, seen AS seen_requests, round(usd + lead_up_usd, 9) AS usd, 2 AS first_seen FROM receipts"
PIECES["old_ledger"] = "SELECT repo, sha, requests, CASE WHEN sha % 2 = 0 THEN seen + sha % 3 - 1 END AS seen_requests, CAST(1.5 AS DOUBLE) AS usd, 1 AS first_seen FROM receipts WHERE sha % 5 < 3"


@query("o_s6_ledger_upsert", """SELECT repo, sha, requests, seen_requests, usd, first_seen, changed FROM (
    SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.sha, n.sha) AS sha, CASE WHEN k THEN o.requests ELSE n.requests END AS requests, CASE WHEN k THEN o.seen ELSE n.seen_requests END AS seen_requests, CASE WHEN k THEN o.usd ELSE n.usd END AS usd,
      coalesce(o.first_seen, n.first_seen) AS first_seen, NOT k AND (o.sha IS NULL OR o.requests <> n.requests OR o.seen <> n.seen_requests OR o.usd <> n.usd) AS changed
    FROM (SELECT *, coalesce(seen_requests, requests) AS seen FROM old_ledger) o FULL JOIN (SELECT * FROM new_ledger WHERE seen_requests > 0) n ON o.repo = n.repo AND o.sha = n.sha
    CROSS JOIN LATERAL (SELECT n.sha IS NULL OR (o.sha IS NOT NULL AND o.seen > n.seen_requests) AS k))""")
def o_s6(spark, sf_dir):
    r = World(spark, sf_dir).receipt()
    new = r.select("repo", "sha", "requests", F.col("seen").alias("seen_requests"), F.round(F.col("usd") + F.col("lead_up_usd"), 9).alias("usd"), F.lit(2).alias("first_seen"))
    old = r.where("sha % 5 < 3").select("repo", "sha", "requests", F.when(F.col("sha") % 2 == 0, F.col("seen") + F.col("sha") % 3 - 1).alias("seen_requests"), F.lit(1.5).alias("usd"), F.lit(1).alias("first_seen"))
    return rollup.ledger_upsert(old, new)


@query("o_s7_commit_export", """SELECT strftime(ts, '%Y-%m-%d') AS date, r.repo, r.sha AS commit, CAST(author AS VARCHAR) AS author, '' AS subject, tier AS matched_by, requests AS ai_requests, round_even(wh_low, 3) AS energy_wh_low, round_even(wh_high, 3) AS energy_wh_high,
    round_even(lead_up_wh_low, 3) AS lead_up_wh_low, round_even(lead_up_wh_high, 3) AS lead_up_wh_high, round_even((wh_low + lead_up_wh_low) / 1000 * 458, 2) AS co2_g_low, round_even((wh_high + lead_up_wh_high) / 1000 * 458, 2) AS co2_g_high
    FROM receipts r JOIN commits c ON r.repo = c.repo AND r.sha = c.sha""")
def o_s7(spark, sf_dir):
    w = World(spark, sf_dir)
    commits = w.commits.select("repo", "sha", "ts", "author", F.concat(F.lit("change "), F.col("sha").cast("string")).alias("subject"))
    return rollup.export(w.receipt(), commits, subjects=False).drop("usd_api_equivalent", "lead_up_usd")  # money is in o_a3, exact


_NOTE = """SELECT repo, sha, CASE WHEN sha % 11 = 0 THEN '{"version": 1, "usd": -1, "wh": [1.5, 2], "requests": 3}' WHEN sha % 11 = 1 THEN '{"version": 1, "usd": 1, "wh": [1, 2, 3], "requests": 3}' WHEN sha % 11 = 2 THEN '{"version": 1, "usd": null, "wh": [1, 2], "requests": 3}'
    WHEN sha % 11 = 3 THEN '{"version": 1, "usd": 1, "wh": [1, 2], "requests": true}' WHEN sha % 11 = 4 THEN 'not json {' WHEN sha % 11 = 5 THEN '{"version": 2, "usd": 1, "wh": [1, 2], "requests": 3}'
    ELSE concat('{"version": 1, "usd": ', k, '.25, "wh": [', k, '.5, ', k + 1, '], "requests": ', k, ', "seen_requests": ', k + 1, '}') END AS note FROM commits"""


@query("o_s10_valid_notes", "SELECT repo, sha, k + 0.25::DOUBLE AS usd, k + 0.5::DOUBLE AS wh_low, CAST(k + 1 AS DOUBLE) AS wh_high, k AS requests, k + 1 AS seen_requests FROM commits WHERE sha % 11 > 5")
def o_s10(spark, sf_dir):
    return rollup.valid_notes(raw_notes(spark, sf_dir))


def raw_notes(spark, sf_dir):
    text = _NOTE.replace("FROM commits", "FROM {commits}")
    return spark.sql(text.replace('{"', '{{"').replace("}'", "}}'").replace("not json {'", "not json {{'"), commits=fx.commits(spark, sf_dir))


@query("o_j15_notes_in_window", "SELECT c.repo, c.sha, c.ts, k + 0.25::DOUBLE AS usd FROM commits c WHERE sha % 11 > 5 AND ts >= TIMESTAMP '2024-01-15 00:00:00'")
def o_j15(spark, sf_dir):
    c = fx.commits(spark, sf_dir).where("ts >= timestamp'2024-01-15 00:00:00'").select("repo", "sha", "ts")
    return rollup.valid_notes(raw_notes(spark, sf_dir)).join(c, ["repo", "sha"]).select("repo", "sha", "ts", "usd")


@query("o_a9_team_rollup", "SELECT repo, contributors, contributors >= 19 AS enough, CASE WHEN contributors >= 19 THEN n END AS noted_commits, CASE WHEN contributors >= 19 THEN cents END AS cents, CASE WHEN contributors >= 19 THEN round(wl, 6) END AS wh_low, CASE WHEN contributors >= 19 THEN round(wh, 6) END AS wh_high, CASE WHEN contributors >= 19 THEN working END AS working, CASE WHEN contributors >= 19 THEN too_new END AS too_new FROM (SELECT repo, count(DISTINCT author) AS contributors, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, sum(wh_low) AS wl, sum(wh_high) AS wh, count(*) FILTER (outcome = 'durable') AS working, count(*) FILTER (outcome = 'too new') AS too_new FROM noted GROUP BY repo)")
def o_a9(spark, sf_dir):
    return rounded(rollup.team(noted(World(spark, sf_dir)), 19), 6, "wh_low", "wh_high")


@query("o_a10_weekly_spend", f"SELECT repo, {_WEEK} AS week, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS commits, count(DISTINCT author) AS people FROM noted GROUP BY repo, {_WEEK}")
def o_a10(spark, sf_dir):
    return rollup.weekly(noted(World(spark, sf_dir)))


PIECES["week_rows"] = f"SELECT repo, {_WEEK} AS week, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS commits, list(DISTINCT author) AS who, row_number() OVER (PARTITION BY repo ORDER BY {_WEEK}) AS n FROM noted GROUP BY repo, {_WEEK}"


@query("o_w13_merged_weeks", """SELECT repo, first_week, last_week, cents, commits FROM (WITH RECURSIVE steps AS (
    SELECT repo, n, week, 1 AS run, who, cents, commits, len(who) >= 12 AS done FROM week_rows WHERE n = 1
    UNION ALL SELECT w.repo, w.n, w.week, CASE WHEN s.done THEN s.run + 1 ELSE s.run END, CASE WHEN s.done THEN w.who ELSE list_distinct(list_concat(s.who, w.who)) END, w.cents, w.commits,
      len(CASE WHEN s.done THEN w.who ELSE list_distinct(list_concat(s.who, w.who)) END) >= 12 FROM steps s JOIN week_rows w ON w.repo = s.repo AND w.n = s.n + 1),
  closed AS (SELECT repo, max(run) FILTER (done) AS last_done FROM steps GROUP BY repo)
  SELECT s.repo, min(week) AS first_week, max(week) AS last_week, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(commits) AS BIGINT) AS commits FROM steps s JOIN closed c ON s.repo = c.repo GROUP BY s.repo, least(run, coalesce(last_done, run)))""")
def o_w13(spark, sf_dir):
    return rollup.merged_weeks(noted(World(spark, sf_dir)), 12)


PIECES["branch_rows"] = "SELECT c.repo, c.sha FROM commits c WHERE sha % 3 = 0 AND sha % 6 <> 0 AND 1 + CAST(sha % 7 = 0 AS INTEGER) < 2"


@query("o_j16_branch_summary", "SELECT repo, sha FROM branch_rows")
def o_j16(spark, sf_dir):
    head, base, commits = _branch(spark, sf_dir)
    return head.join(base, ["repo", "sha"], "left_anti").join(commits.where("n_parents < 2"), ["repo", "sha"], "left_semi").select("repo", "sha")


def _branch(spark, sf_dir):
    c = fx.commits(spark, sf_dir).withColumn("n_parents", (F.col("sha") % 7 == 0).cast("int") + 1)
    return c.where("sha % 3 = 0").select("repo", "sha"), c.where("sha % 6 = 0").select("repo", "sha"), c


@query("o_a11_branch_totals", "SELECT b.repo, count(*) AS commits, count(*) FILTER (wh_high + lead_up_wh_high > 0) AS with_ai, round(coalesce(sum(wh_low + lead_up_wh_low), 0), 6) AS wh_low, round(coalesce(sum(wh_high + lead_up_wh_high), 0), 6) AS wh_high, round(coalesce(sum(usd + lead_up_usd), 0), 8) AS usd FROM branch_rows b LEFT JOIN receipts r ON r.repo = b.repo AND r.sha = b.sha GROUP BY b.repo")
def o_a11(spark, sf_dir):
    head, base, commits = _branch(spark, sf_dir)
    return rounded(rounded(rollup.branch(World(spark, sf_dir).receipt(), head, base, commits), 6, "wh_low", "wh_high"), 8, "usd")


PIECES["sci"] = """SELECT wl / 1000 * 498 AS g_low, wh / 1000 * 528 AS g_high, tokens, commits, working, jl / 1000 * 498 AS jg_low, jh / 1000 * 528 AS jg_high FROM
    (SELECT sum(wh_low) AS wl, sum(wh_high) AS wh, CAST(sum(fresh_in + cache_write + cache_read + output) AS BIGINT) AS tokens FROM measured), (SELECT count(*) AS commits FROM receipts),
    (SELECT sum(wh_low) FILTER (outcome <> 'too new') AS jl, sum(wh_high) FILTER (outcome <> 'too new') AS jh, count(*) FILTER (outcome = 'durable') AS working FROM noted)"""


@query("o_a12_carbon_intensity", "SELECT tokens, commits, working, round(g_low, 4) AS g_low, round(g_high, 4) AS g_high, round(g_low / (tokens / 1e6), 6) AS g_per_mtok_low, round(g_high / (tokens / 1e6), 6) AS g_per_mtok_high, round(g_low / commits, 6) AS g_per_commit_low, round(g_high / commits, 6) AS g_per_commit_high, round(jg_low / working, 6) AS g_per_working_low, round(jg_high / working, 6) AS g_per_working_high FROM sci")
def o_a12(spark, sf_dir):
    w = World(spark, sf_dir)
    c = rollup.carbon(w.measured, w.named, noted(w))
    return rounded(rounded(c, 4, "g_low", "g_high"), 6, *[x for x in c.columns if "_per_" in x])


@query("o_s8_disclosure", "SELECT to_json({'tokens': tokens, 'commits': commits, 'working': working}) AS disclosure FROM sci")
def o_s8(spark, sf_dir):
    w = World(spark, sf_dir)
    return rollup.carbon(w.measured, w.named, noted(w)).select(F.to_json(F.struct("tokens", "commits", "working")).alias("disclosure"))


@query("o_a36_tips", "SELECT 'smaller model' AS tip, CAST(nano AS BIGINT) AS saved_nano_usd, round(share, 6) AS share FROM model_saving")
def o_a36(spark, sf_dir):
    """Savings worth acting on, by money; the fresh session is a fact (o_a14), not a tip."""
    s = savings.smaller_model(fx.requests(spark, sf_dir), dims.prices(spark), dims.ends(spark))
    return s.select(F.lit("smaller model").alias("tip"), "saved_nano_usd", F.round("share", 6).alias("share")).orderBy(F.col("saved_nano_usd").desc())


@query("o_a32_card", """SELECT (SELECT CAST(sum(nano_usd) AS BIGINT) FROM measured) AS nano_usd, (SELECT count(*) FROM receipts) AS commits, (SELECT round(sum(wh_high) / 1000, 6) FROM measured) AS kwh_high,
    (SELECT round(median(usd), 8) FROM stated WHERE seen > 0 AND status LIKE 'kept%') AS typical_usd, (SELECT CAST(nano AS BIGINT) FROM model_saving) AS tip_nano_usd, (SELECT sum(cents) FILTER (outcome <> 'too new') / count(*) FILTER (outcome = 'durable') FROM noted) AS cents_per_working""")
def o_a32(spark, sf_dir):
    w = World(spark, sf_dir)
    spent = measured(spark, sf_dir).agg(F.sum("nano_usd").alias("nano_usd"), F.round(F.sum("wh_high") / 1000, 6).alias("kwh_high"))
    one = spent.crossJoin(w.named.agg(F.count("*").alias("commits"))).crossJoin(rollup.typical(stated(w)).select(F.round("usd", 8).alias("typical_usd")))
    tip = savings.smaller_model(w.requests, dims.prices(spark), dims.ends(spark)).select(F.col("saved_nano_usd").alias("tip_nano_usd"))
    from agentmeter.operators import kept

    per = kept.judgement(noted(w)).select(F.col("cents_per_durable").alias("cents_per_working"))
    return one.crossJoin(tip).crossJoin(per)

