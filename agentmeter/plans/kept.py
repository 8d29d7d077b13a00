"""Queries on what became of commits."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.operators import kept
from agentmeter.plans.registry import PIECES, query
from agentmeter.sources import shared

_NOW = f"TIMESTAMP '{fx.NOW}'"
PIECES["patch_base"] = "SELECT * FROM patch_commits WHERE sha < 1000000"
PIECES["squash_candidates"] = f"SELECT p.* FROM patch_base p WHERE ts + INTERVAL 7 DAY <= {_NOW} AND NOT EXISTS (SELECT 1 FROM ref_commits r WHERE r.repo = p.repo AND r.sha = p.sha)"
PIECES["patch_digests"] = "SELECT repo, sha, md5(string_agg(l, chr(10) ORDER BY l)) AS digest FROM (SELECT DISTINCT repo, sha, path || side || regexp_replace(line, '\\s+', '', 'g') AS l FROM commit_lines) GROUP BY repo, sha"
PIECES["picks"] = "SELECT c.repo, c.sha FROM squash_candidates c JOIN patch_digests d ON c.repo = d.repo AND c.sha = d.sha WHERE EXISTS (SELECT 1 FROM patch_digests u JOIN ref_commits r ON u.repo = r.repo AND u.sha = r.sha WHERE u.repo = c.repo AND u.digest = d.digest)"
PIECES["plus_lines"] = "SELECT DISTINCT repo, sha, path, line FROM commit_lines WHERE side = '+'"
PIECES["squashes"] = """SELECT DISTINCT repo, sha FROM (SELECT c.repo, c.sha, u.sha AS up, count(*) AS n FROM squash_candidates c JOIN plus_lines l ON l.repo = c.repo AND l.sha = c.sha
    JOIN plus_lines u ON u.repo = l.repo AND u.path = l.path AND u.line = l.line JOIN ref_commits r ON r.repo = u.repo AND r.sha = u.sha JOIN patch_commits t ON t.repo = u.repo AND t.sha = u.sha
    WHERE t.ts BETWEEN c.ts AND c.ts + INTERVAL 30 DAY GROUP BY c.repo, c.sha, u.sha) x WHERE n = (SELECT count(*) FROM plus_lines p WHERE p.repo = x.repo AND p.sha = x.sha)"""
PIECES["statuses"] = f"""SELECT p.repo, p.sha, CASE WHEN ref_updated IS NULL THEN 'git error' WHEN p.ts + INTERVAL 7 DAY > {_NOW} THEN 'pending' WHEN r.sha IS NOT NULL OR k.sha IS NOT NULL THEN 'kept'
    WHEN s.sha IS NOT NULL THEN 'kept (squash)' WHEN ref_updated < p.ts + INTERVAL 7 DAY THEN 'unknown (stale)' WHEN m.sha IS NULL THEN 'unknown (squash)' ELSE 'discarded' END AS status
    FROM patch_base p LEFT JOIN repo_refs f ON f.repo = p.repo LEFT JOIN ref_commits r ON r.repo = p.repo AND r.sha = p.sha LEFT JOIN picks k ON k.repo = p.repo AND k.sha = p.sha
    LEFT JOIN squashes s ON s.repo = p.repo AND s.sha = p.sha LEFT JOIN (SELECT DISTINCT repo, sha FROM plus_lines) m ON m.repo = p.repo AND m.sha = p.sha"""
PIECES["hashed"] = "SELECT *, substr(md5(CAST(sha AS VARCHAR)) || md5(CAST(sha AS VARCHAR)), 1, 40) AS hash FROM patch_base"
PIECES["bodies"] = "SELECT repo, 'Back out.' || chr(10) || 'This reverts commit ' || hash || '. See ' || upper(hash) AS body FROM hashed WHERE sha % 13 = 5"
PIECES["reverts"] = "SELECT DISTINCT repo, regexp_extract(body, 'commit ([0-9a-f]{40})\\.', 1) AS hash FROM bodies"
PIECES["rework"] = """SELECT a.repo, a.sha, count(*) AS added, count(*) FILTER (EXISTS (SELECT 1 FROM commit_lines m JOIN patch_commits t ON t.repo = m.repo AND t.sha = m.sha JOIN ref_commits r ON r.repo = m.repo AND r.sha = m.sha
    WHERE m.side = '-' AND m.repo = a.repo AND m.path = a.path AND m.line = a.line AND t.ts > c.ts AND t.ts <= c.ts + INTERVAL 30 DAY)) AS gone
    FROM plus_lines a JOIN patch_commits c ON c.repo = a.repo AND c.sha = a.sha GROUP BY a.repo, a.sha"""
PIECES["doc_ledger"] = "SELECT repo, sha, hash, ts, CAST(sha % 97 + 1 AS BIGINT) AS cents, CAST(sha % 7 AS BIGINT) AS author FROM hashed"
PIECES["outcomes"] = f"""SELECT l.*, CASE WHEN l.ts + INTERVAL 30 DAY > {_NOW} THEN 'too new' WHEN status = 'git error' THEN 'unreadable' WHEN v.hash IS NOT NULL THEN 'reverted'
    WHEN status IS NULL OR NOT starts_with(status, 'kept') THEN 'not kept' WHEN gone >= added * 0.30::DOUBLE THEN 'reworked' ELSE 'durable' END AS outcome
    FROM doc_ledger l LEFT JOIN statuses s ON s.repo = l.repo AND s.sha = l.sha LEFT JOIN reverts v ON v.repo = l.repo AND v.hash = l.hash LEFT JOIN rework w ON w.repo = l.repo AND w.sha = l.sha"""
_JUDGED = "outcome IN ('durable', 'reverted', 'reworked', 'not kept')"
JUDGEMENT = f"""count(*) FILTER (outcome = 'durable') AS durable, count(*) FILTER (outcome = 'reverted') AS reverted, count(*) FILTER (outcome = 'reworked') AS reworked, count(*) FILTER (outcome = 'not kept') AS not_kept,
    count(*) FILTER (outcome = 'too new') AS too_new, count(*) FILTER (outcome = 'unreadable') AS unreadable, CAST(coalesce(sum(cents) FILTER ({_JUDGED}), 0) AS BIGINT) AS cents,
    CAST(coalesce(sum(cents) FILTER (outcome = 'durable'), 0) AS BIGINT) AS durable_cents, min(ts) FILTER (outcome = 'too new') AS first_judgeable_ts"""


def now():
    return F.lit(fx.NOW).cast("timestamp")


class History:
    def __init__(self, spark, sf_dir):
        self.all, self.lines = fx.patch_commits(spark, sf_dir), fx.commit_lines(spark, sf_dir)
        self.base, self.on_ref, self.refs = self.all.where("sha < 1000000"), fx.ref_commits(spark, sf_dir), fx.repo_refs(spark, sf_dir)
        digest = F.md5(F.col("sha").cast("string"))
        self.hashed = self.base.withColumn("hash", F.substring(F.concat(digest, digest), 1, 40))
        self.candidates = self.base.where(F.col("ts") + F.expr("INTERVAL 7 DAY") <= now()).join(self.on_ref, ["repo", "sha"], "left_anti")
        self.bodies = self.hashed.where("sha % 13 = 5").select("repo", F.concat(F.lit("Back out.\nThis reverts commit "), "hash", F.lit(". See "), F.upper("hash")).alias("body"))
        self.ledger = self.hashed.select("repo", "sha", "hash", "ts", (F.col("sha") % 97 + 1).alias("cents"), (F.col("sha") % 7).alias("author"))

    @cached_property
    def rows(self):
        return shared.written(kept.keyed(self.lines, self.all, self.on_ref), "keyed")

    @cached_property
    def read(self):
        return self.rows, shared.written(kept.facts(self.rows), "facts")

    def statuses(self):
        return kept.statuses(self.base, self.all, self.lines, self.on_ref, self.refs, now(), self.read)

    def outcomes(self):
        return kept.judged(self.ledger, self.statuses(), kept.reverted(self.bodies), kept.rework_share(self.all, self.lines, self.on_ref, self.read), now())


@query("o_j10_reachable", "SELECT p.repo, p.sha, r.sha IS NOT NULL AS on_ref FROM patch_commits p LEFT JOIN ref_commits r ON r.repo = p.repo AND r.sha = p.sha")
def o_j10(spark, sf_dir):
    h = History(spark, sf_dir)
    return h.all.join(h.on_ref.withColumn("__on", F.lit(True)), ["repo", "sha"], "left").select("repo", "sha", F.coalesce("__on", F.lit(False)).alias("on_ref"))


@query("o_j11_patch_id_match", "SELECT repo, sha FROM picks")
def o_j11(spark, sf_dir):
    h = History(spark, sf_dir)
    return kept.picked(h.candidates, h.rows)


@query("o_j12_squash_containment", "SELECT repo, sha FROM squashes")
def o_j12(spark, sf_dir):
    h = History(spark, sf_dir)
    return kept.squashed(h.candidates, h.lines, h.all, h.on_ref, h.read)


@query("o_j13_reverts", "SELECT repo, hash FROM reverts")
def o_j13(spark, sf_dir):
    return kept.reverted(History(spark, sf_dir).bodies)


@query("o_j14_rework_share", "SELECT repo, sha, added, gone FROM rework")
def o_j14(spark, sf_dir):
    h = History(spark, sf_dir)
    return kept.rework_share(h.all, h.lines, h.on_ref)  # one pass: nothing to write


@query("o_a34_kept_status", "SELECT repo, sha, status FROM statuses")
def o_a34(spark, sf_dir):
    return History(spark, sf_dir).statuses()


@query("o_a8_judgement", f"SELECT repo, durable, reverted, reworked, not_kept, too_new, unreadable, cents, durable_cents, first_judgeable_ts, CASE WHEN durable > 0 THEN cents / durable END AS cents_per_durable, CASE WHEN cents > 0 THEN (cents - durable_cents) / cents END AS waste_ratio FROM (SELECT repo, {JUDGEMENT} FROM outcomes GROUP BY repo)")
def o_a8(spark, sf_dir):
    return kept.judgement(History(spark, sf_dir).outcomes(), ["repo"])


@query("o_w16_default_ref", """SELECT repo, ref, greatest(tip_ts, reflog_ts) AS updated FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tip_ts DESC, ref) AS n FROM (
    SELECT repo, 'ref' || (sha % 3) AS ref, max(ts) AS tip_ts, max(ts) + INTERVAL 1 HOUR AS reflog_ts FROM patch_commits GROUP BY ALL)) WHERE n = 1""")
def o_w16(spark, sf_dir):
    tips = fx.patch_commits(spark, sf_dir).groupBy("repo", F.concat(F.lit("ref"), (F.col("sha") % 3).cast("string")).alias("ref")).agg(F.max("ts").alias("tip_ts"))
    return kept.default_ref(tips.withColumn("reflog_ts", F.col("tip_ts") + F.expr("INTERVAL 1 HOUR")))
