"""Receipts kept up batch by batch: only sessions that new rows can change are attributed again, everything else is merged.

A batch (a day, say) brings requests, commits, calls and so on. What it brings is appended and never rewritten. From an index with a row for each session
and batch follows which sessions are touched, and which batches hold their rows; only those are read. Their sums a commit replace the older ones, and
only the commits concerned get a new receipt. Read in full each time are narrow tables alone: the index, the ids of requests, anchors and sums.

All tables of a batch become visible at once by a marker that is written last. A batch that runs again starts from those before it and writes the same
again; batches come in the order of their numbers.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from agentmeter.operators import attribution as at
from agentmeter.operators import requests as rq
from agentmeter.sources import shared

#: What a batch brings. requests: rows as logs have them, copies and all; ran: (session_id, repo) where sessions ran; files come in the batch of their commit.
INPUTS = ("requests", "ran", "commits", "calls", "touched", "files")
_SUMS = ("wh_low", "wh_high", "lead_up_wh_low", "lead_up_wh_high", "nano", "lead_up_nano")


class Store:
    """The receipts under path, and what is needed to carry them on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[int]:
        """Numbers of the batches that are there as a whole."""
        fs, top = pyarrow.fs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/done", allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def _finish(self, number: int) -> None:
        fs, top = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{top}/done", recursive=True)
        with fs.open_output_stream(f"{top}/done/_{number}") as stream:
            stream.write(b"")
        fs.move(f"{top}/done/_{number}", f"{top}/done/{number}")

    def _put(self, name: str, number: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        return self._get(name, [number], df.schema)

    def _get(self, name: str, numbers: list[int], schema: StructType) -> DataFrame:
        """Rows of a table from these batches, with the column batch."""
        fields = StructType([*schema.fields, StructField("batch", LongType())])
        if not numbers:
            return self.spark.createDataFrame([], fields)
        read = self.spark.read.schema(fields).option("basePath", f"{self.path}/{name}")
        return read.parquet(*[f"{self.path}/{name}/batch={n}" for n in numbers])

    def receipts(self) -> DataFrame:
        """The receipt of each commit as attribution.receipt() has it."""
        numbers = self.batches()
        if not numbers:
            raise ValueError(f"no batch has been finished under {self.path}")
        read = self.spark.read.option("basePath", f"{self.path}/receipts").parquet(*[f"{self.path}/receipts/batch={n}" for n in numbers])
        fields = [c for c in read.columns if c not in ("repo", "sha", "batch")]
        last = read.groupBy("repo", "sha").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("repo", "sha", "r.*")
        return last.where("tier IS NOT NULL")

    def add(self, number: int, new: Mapping[str, DataFrame], who: DataFrame, prices: DataFrame, ends: DataFrame) -> DataFrame:
        """Takes a batch in and returns the sessions that were attributed again.

        who, (session_id, repo, author), is read as a whole; an identity that changes counts from its session's next rows on. A call whose end was not yet known
        may come again with it. Rows without a session belong to no commit.
        """
        done = self.batches()
        if done and done[-1] > number:
            raise ValueError(f"batch {done[-1]} is there already, so {number} comes too late")
        old = [n for n in done if n < number]
        both = [*old, number]
        mine, before, every = {}, {}, {}
        for name in INPUTS:
            mine[name] = self._put(name, number, new[name])
            before[name], every[name] = self._get(name, old, new[name].schema), self._get(name, both, new[name].schema)

        def kept(name: str, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            return self._put(name, number, df), self._get(name, old, df.schema), self._get(name, both, df.schema)

        spans = mine["requests"].groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        seen = reduce(DataFrame.union, [mine[n].select("session_id") for n in ("requests", "ran", "calls", "touched")]).where("session_id IS NOT NULL").distinct()
        came, _, presence = kept("presence", seen.join(spans, "session_id", "left"))
        _, _, pairs = kept("repos", at.session_repos(mine["ran"].select("session_id", "repo"), mine["calls"], mine["touched"]))
        repos = pairs.select("session_id", "repo").distinct()

        # Requests that several sessions hold: the one with the best copy has them.
        ids = mine["requests"].select("request_id").distinct()
        copy = lambda df: df.select("request_id", "session_id", "output", "ts", "file_path")
        copies = copy(before["requests"]).join(ids, "request_id", "left_semi").unionAll(copy(mine["requests"]))
        rank = F.struct(F.col("output"), -F.unix_micros("ts"), F.col("file_path"))
        best = copies.groupBy("request_id").agg(F.max_by("session_id", rank).alias("owner"), (F.min("session_id") != F.max("session_id")).alias("several"))
        shared_now, _, shared_ever = kept("owners", best.where("several").select("request_id", "owner"))
        holders = copies.join(shared_now, "request_id", "left_semi").select("session_id")

        anchors, anchors_before, anchors_all = kept("anchors", self._new_anchors(mine, every, self._get("anchors", old, _anchor_schema(new))))
        taken = anchors.join(anchors_before, ["repo", "sha"], "left_anti").select("repo", "sha").distinct()
        near = _between(every["commits"], "ts", *_bounds(anchors, "commit_ts", "commit_ts"))
        moved = mine["commits"].unionByName(near.join(taken, ["repo", "sha"], "left_semi")).select("repo", "sha", F.col("ts").alias("commit_ts"), "author").distinct()
        windows = presence.groupBy("session_id").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).where("first_ts IS NOT NULL")
        touched_by = at.own_commits_near(_own(_overlapping(windows, *_bounds(moved, "commit_ts", "commit_ts")), repos, who), moved).select("session_id")
        again = reduce(DataFrame.union, [came.select("session_id"), holders, anchors.select("session_id"), touched_by]).distinct()
        again, _, attributed = kept("attributed", again)
        again = again.select("session_id")

        sums = self._sums(again, presence, windows, every, repos, who, shared_ever, anchors_all, prices, ends)
        now, sums_before, sums_all = kept("sums", sums)
        current = attributed.groupBy("session_id").agg(F.max("batch").alias("batch"))
        changed = reduce(DataFrame.union, [df.select("repo", "sha") for df in (now, anchors, sums_before.join(again, "session_id", "left_semi"))]).distinct()
        valid = sums_all.join(changed, ["repo", "sha"], "left_semi").join(current, ["session_id", "batch"], "left_semi")
        self._put("receipts", number, _receipts(changed, valid, anchors_all))
        self._finish(number)
        return again

    def _new_anchors(self, mine: dict[str, DataFrame], every: dict[str, DataFrame], before: DataFrame) -> DataFrame:
        """Anchors that this batch's calls or commits make; both sides meet only near in time."""
        end = F.coalesce("end_ts", "start_ts")
        calls = mine["calls"].withColumn("last", end)
        by_call = at.anchors(mine["calls"], _between(every["commits"], "ts", *_bounds(calls, "start_ts", "last")))
        lo, hi = _bounds(mine["commits"], "ts", "ts")
        pad = F.expr(f"INTERVAL {at.PAD} SECOND")
        open_ = every["calls"].where((F.col("start_ts") <= hi + pad) & (end >= lo - pad))
        by_commit = at.anchors(open_, mine["commits"])
        return by_call.union(by_commit).distinct().join(before, ["session_id", "repo", "sha"], "left_anti")

    def _sums(self, again, presence, windows, every, repos, who, owners, anchors, prices, ends) -> DataFrame:
        """What each session of again gave to each commit. Reads only the batches that hold these sessions' rows."""
        places = sorted(r.batch for r in presence.join(again, "session_id", "left_semi").select("batch").distinct().collect())  # as many as there are batches
        own = lambda df: df.where(F.col("batch").isin(places)).join(again, "session_id", "left_semi")
        owner = owners.groupBy("request_id").agg(F.max_by("owner", "batch").alias("owner"))
        rows = own(every["requests"]).join(owner, "request_id", "left").where("owner IS NULL OR owner = session_id").drop("owner", "batch")
        requests = shared.written(rq.dedupe(rows), "again")
        touched = own(every["touched"]).select("session_id", "repo", "path").distinct()
        mine = repos.join(again, "session_id", "left_semi")
        span = windows.join(again, "session_id", "left_semi")
        lo, hi = _bounds(span, "first_ts", "last_ts")
        commits = _between(every["commits"], "ts", lo, hi)
        candidates = at.own_commits_near(_own(span, mine, who), commits.select("repo", "sha", F.col("ts").alias("commit_ts"), "author", F.col("batch").alias("at_batch"))).select("repo", "sha", "at_batch").distinct()
        candidates = shared.written(candidates, "candidates")
        holds = sorted(r.at_batch for r in candidates.select("at_batch").distinct().collect())  # as many as there are batches
        files = every["files"].where(F.col("batch").isin(holds)).join(candidates, ["repo", "sha"], "left_semi").drop("batch")
        commits = commits.join(candidates, ["repo", "sha"], "left_semi").select("repo", "sha", "ts", "author").distinct()
        marks = anchors.select("session_id", "repo", "sha", "commit_ts")

        slim = requests.select("request_id", "session_id", "ts")
        placed = shared.written(at.segments(slim, marks.join(again, "session_id", "left_semi")), "placed")
        exact, left = at.exact(placed)
        shown = touched.select("session_id").distinct()
        fuzzy_left = left.join(shown, "session_id", "left_semi")
        matches = shared.written(at.fuzzy(fuzzy_left, mine, commits, files, touched, who, marks), "matches")
        timed, _ = at.time_only(left.join(shown, "session_id", "left_anti"), mine, commits, who, marks)
        rows = exact.unionByName(at.fuzzy_rows(fuzzy_left, matches)).unionByName(timed)
        measured = rq.measured(requests, prices, ends).select("request_id", "wh_low", "wh_high", "nano_usd")
        w, lead = F.col("weight"), F.col("lead_up")
        usd = F.coalesce("nano_usd", F.lit(0)) * w
        part = lambda cond, x, name: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0)).alias(name)
        parts = [part(c, x, f"{p}{n}") for c, p in ((~lead, ""), (lead, "lead_up_")) for n, x in (("wh_low", F.col("wh_low") * w), ("wh_high", F.col("wh_high") * w), ("nano", usd))]
        by = rows.join(measured, "request_id").groupBy("repo", "sha", "session_id").agg(F.max("tier").alias("tier"), *parts, F.sum(w).alias("weight"), F.min(w).alias("low"), F.max(w).alias("high"), F.count("*").alias("n"), F.count_distinct("request_id").alias("seen"))
        return by.join(slim.groupBy("session_id").agg(F.min("ts").alias("began")), "session_id")


def _anchor_schema(new: Mapping[str, DataFrame]) -> StructType:
    calls, commits = new["calls"].schema, new["commits"].schema
    return StructType([calls["session_id"], calls["repo"], commits["sha"], StructField("commit_ts", TimestampType())])


def _bounds(df: DataFrame, first: str, last: str) -> tuple[Column, Column]:
    """The earliest first and the latest last, as columns; nulls if there are no rows."""
    row = df.agg(F.unix_micros(F.min(first)).alias("lo"), F.unix_micros(F.max(last)).alias("hi")).first()
    return tuple(F.timestamp_micros(F.lit(x).cast("long")) for x in (row.lo, row.hi))


def _between(df: DataFrame, column: str, lo: Column, hi: Column) -> DataFrame:
    """Rows that can matter to something from lo to hi: a filter that the scan takes. Nulls let none through."""
    slack = lambda n: F.expr(f"INTERVAL {n} SECOND")
    return df.where((F.col(column) >= lo - slack(at.PAD)) & (F.col(column) <= hi + slack(at.GRACE)))


def _overlapping(windows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Sessions whose window, with its grace, meets lo to hi."""
    slack = lambda n: F.expr(f"INTERVAL {n} SECOND")
    return windows.where((F.col("last_ts") >= lo - slack(at.GRACE)) & (F.col("first_ts") <= hi + slack(at.PAD)))


def _own(windows: DataFrame, repos: DataFrame, who: DataFrame) -> DataFrame:
    return windows.join(repos, "session_id").join(who.where("author IS NOT NULL"), ["session_id", "repo"])


def _receipts(changed: DataFrame, valid: DataFrame, anchors: DataFrame) -> DataFrame:
    """Receipts of changed commits from the sums of their sessions; a commit that lost its last row gets a null tier."""
    total = lambda c: F.sum(c).alias(c)
    first = F.min_by("tier", F.struct("began", "session_id"))
    sums = valid.groupBy("repo", "sha").agg(F.when(F.max(F.col("tier") == "exact"), "exact").otherwise(first).alias("given"), *[total(c) for c in (*_SUMS, "weight", "seen", "n")], F.min("low").alias("low"), F.max("high").alias("high"))
    anchored = anchors.select("repo", "sha").distinct().withColumn("anchored", F.lit(True))
    r = changed.join(sums, ["repo", "sha"], "left").join(anchored, ["repo", "sha"], "left")
    n = lambda c: F.coalesce(c, F.lit(0.0))
    requests = at.counted_rows(F.col("low"), F.col("high"), F.col("n"), F.col("weight"))
    return r.select(
        "repo", "sha", F.when(F.col("anchored"), "exact").otherwise(F.col("given")).alias("tier"), *[n(F.col(c)).alias(c) for c in _SUMS[:4]],
        (n(F.col("nano")) / 1e9).alias("usd"), (n(F.col("lead_up_nano")) / 1e9).alias("lead_up_usd"),
        F.coalesce(requests, F.lit(0)).cast("long").alias("requests"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"),
    )


__all__ = ["INPUTS", "Store"]
