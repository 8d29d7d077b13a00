"""Per-session live state as a structured stream: cost of the open task, context carried over, commits announced once.

Input files are read as they come; a producer that appends must write rotated segments, since a file is read once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from agentmeter.operators.rollup import ledger_upsert, typical

# Microseconds between two sights of one commit, times the usual cost at which a task turns amber and red, and the least carried share shown.
GUARD_US, AMBER, RED, SHOWN_SHARE = 120_000_000, 1.5, 3.0, 0.05
LATE, IDLE = "2 hours", "2 hours"
#: After how long the state of an idle session is dropped, and a baseline is computed anew.
IDLE_MINUTES, BASELINE_AGE = 7 * 24 * 60, timedelta(days=1)
#: Parts of the streamed ledger.
LEDGER_PARTS = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ROWS = "session_id long, ts timestamp, kind string, request_id long, output long, nano_usd long, ctx long, is_sidechain boolean"
STATE = "session_id long, task_nano_usd long, task_requests int, commits int, base_ctx long, last_ctx long, carried long, announced array<timestamp>"
_STATE = [c.split()[0] for c in STATE.split(", ")]
LATENESS = "session_id long, came long, ts timestamp, late boolean"
#: A request row within a batch.
REQUEST = np.dtype([("at", "i8"), ("id", "i8"), ("output", "i8"), ("nano", "i8"), ("ctx", "i8"), ("main", "?")])
#: Buckets of sessions, and sessions of a frame that leaves one.
BUCKETS, OUT = 1024, 10_000
#: A request of the open task in the state.
OPEN = np.dtype([("id", "i8"), ("output", "i8"), ("nano", "i8")])


class Batch:
    """A session's rows of one micro-batch, reduced as they come in parts.

    The batch's last announced commit is at most GUARD_US before its last commit, so requests before that are done with once their context is
    noted; later ones are kept as numbers, 41 bytes a row, until all commits are known. Nothing needs the rows in order.
    """

    def __init__(self) -> None:
        self.first, self.last = None, None
        self.commits: list[np.ndarray] = []
        self.newest = -(2**63)
        self.kept: list[np.ndarray] = []

    def add(self, commits: np.ndarray, requests: np.ndarray) -> None:
        """commits: their times; requests: rows of REQUEST."""
        if len(commits):
            self.commits.append(np.unique(commits))
            self.newest = max(self.newest, int(self.commits[-1][-1]))
        self._note(requests)
        self.kept.append(requests[requests["at"] > self.newest - GUARD_US])
        if len(self.kept) > 64:
            self._thin()

    def _thin(self) -> None:
        kept = np.concatenate(self.kept)
        self.kept = [kept[kept["at"] > self.newest - GUARD_US]]

    def _note(self, rows: np.ndarray) -> None:
        """The earliest main request with a context and the latest main one."""
        main = rows[rows["main"]]
        if len(main):
            end = main[np.lexsort((main["output"], main["id"], main["at"]))[-1]]
            place = tuple(end[_ORDER].tolist())
            if self.last is None or place > self.last[0]:
                self.last = place, int(end["ctx"])
        self.first = _earliest(main, self.first)

    def settle(self, commit_us: int) -> tuple[list[int], np.ndarray]:
        """The announced commits, and the requests after the last of them (all kept ones, if none is)."""
        announced = []
        for at in np.unique(np.concatenate(self.commits)).tolist() if self.commits else []:
            if commit_us < 0 or commit_us < at - GUARD_US:
                commit_us = at
                announced.append(at)
        self._thin()
        kept = self.kept[0]
        return announced, kept[kept["at"] > announced[-1]] if announced else kept


_ORDER = ["at", "id", "output"]


def _earliest(rows: np.ndarray, so_far: tuple | None = None) -> tuple | None:
    """(order, context) of the earliest of main rows that has a context."""
    rows = rows[rows["ctx"] > 0]
    if not len(rows):
        return so_far
    row = rows[np.lexsort((rows["output"], rows["id"], rows["at"]))[0]]
    found = tuple(row[_ORDER].tolist()), int(row["ctx"])
    return found if so_far is None or found[0] < so_far[0] else so_far


def _fullest(task: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The task's requests (OPEN) with those of fresh (REQUEST): of each the largest output, what was there or is earlier first."""
    if not len(fresh):
        return task
    new = fresh[np.argsort(fresh["at"], kind="stable")]
    both = np.empty(len(task) + len(new), OPEN)
    for name in OPEN.names:
        both[name][: len(task)] = task[name]
        both[name][len(task) :] = new[name]
    both = both[np.lexsort((-both["output"], both["id"]))]  # stable: equal outputs stay in order
    return both[np.append(True, both["id"][1:] != both["id"][:-1])]


def _by_session(rows: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(session, newest time, times of commits, requests) of each session in rows."""
    order = np.argsort(rows["session_id"].to_numpy(np.int64), kind="stable")
    session = rows["session_id"].to_numpy(np.int64)[order]
    at = rows["ts"].to_numpy("datetime64[us]").astype(np.int64)[order]
    commit = (rows["kind"].to_numpy() == "commit")[order]
    own = order[~commit]
    requests = np.zeros(len(own), REQUEST)
    requests["at"] = at[~commit]
    for name, column in (("id", "request_id"), ("output", "output"), ("nano", "nano_usd"), ("ctx", "ctx")):
        requests[name] = rows[column].to_numpy()[own].astype(np.int64)
    requests["main"] = ~rows["is_sidechain"].to_numpy()[own].astype(bool)
    before = np.concatenate([[0], np.cumsum(~commit)])
    starts = np.flatnonzero(np.append(True, session[1:] != session[:-1])[: len(session)])
    for i, j in zip(starts.tolist(), np.append(starts[1:], len(session)).tolist(), strict=True):
        yield int(session[i]), int(at[i:j].max()), at[i:j][commit[i:j]], requests[before[i] : before[j]]


class LiveState(StatefulProcessor):
    """State of sessions: the open task's requests, each with its largest output, and a few numbers. A session's goes when it has been idle.

    The key is a bucket of sessions, so that frames, both ways, hold many sessions; one of a session each costs milliseconds, whatever is in it. A session is an
    entry of the bucket's map, its requests 24 bytes each, read and written once a batch that touches it. A bucket has one timer, for the session that
    is idle first, rounded up to a sixteenth of the idle time; what is idle when it fires is dropped.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session_id long", "session_id long, base long, last long, after long, commit_us long, commits int, seen_ms long, open binary")
        self.timer = handle.getValueState("timer", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches: dict[int, Batch] = {}
        latest: dict[int, int] = {}
        for part in rows:
            for session, newest, commits, requests in _by_session(part):
                batches.setdefault(session, Batch()).add(commits, requests)
                latest[session] = max(latest.get(session, 0), newest // 1000)
        self._timed(min(latest.values()))
        out = []
        for session in list(batches):
            out.append(self._next(session, batches.pop(session), latest[session]))
            if len(out) == OUT or not batches:
                yield pd.DataFrame(out, columns=_STATE)
                out = []

    def _next(self, session: int, batch: Batch, latest: int) -> tuple:
        """The session's new state, which is stored, as a row of STATE."""
        stored = self.sessions.getValue((session,)) if self.sessions.containsKey((session,)) else (session, 0, 0, 0, -1, 0, 0, b"")
        _, base, last, after, commit_us, commits, seen_ms, held = stored
        announced, fresh = batch.settle(commit_us)
        if announced:
            commit_us, commits, after, held = announced[-1], commits + len(announced), 0, b""
        last = batch.last[1] if batch.last else last
        base = base or (batch.first[1] if batch.first else 0)
        first = _earliest(fresh[fresh["main"]])
        after = after or (first[1] if commits and first else 0)
        task = _fullest(np.frombuffer(held, OPEN), fresh)
        self.sessions.updateValue((session,), (session, base, last, after, commit_us, commits, max(seen_ms, latest), task.tobytes()))
        carried = max(0, after - base) if commits else 0
        return session, int(task["nano"].sum()), len(task), commits, base, last, carried, [pd.Timestamp(us, unit="us") for us in announced]

    def _timed(self, seen_ms: int) -> None:
        """Has the timer fire by the time that a session seen then is idle."""
        step = max(1, self.idle_ms // 16)
        at = -(-(seen_ms + self.idle_ms) // step) * step
        now = self.timer.get()
        if now is None or at < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a session's last row by the idle time: its state is dropped, and it begins anew if it comes back."""
        self.timer.clear()
        limit, oldest = timerValues.getCurrentWatermarkInMs() - self.idle_ms, None
        for session, *_, seen_ms, _ in list(self.sessions.values()):
            if seen_ms <= limit:
                self.sessions.removeKey((session,))
            else:
                oldest = seen_ms if oldest is None else min(oldest, seen_ms)
        if oldest is not None:
            self._timed(oldest)
        return iter(())

    def close(self) -> None:
        pass


def live_states(rows: DataFrame, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """A row of STATE for each session and micro-batch that touched it. rows: a stream of ROWS, in any order within a batch.

    The watermark drops rows that are late by more than LATE (split them off with late_split() to keep them), and the state of sessions
    that it has passed by idle_minutes.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=LiveState(idle_minutes * 60_000), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


class LateState(StatefulProcessor):
    """State of a session: its clock, the newest time that has come. It goes when nothing has come for the idle time."""

    def __init__(self, late_us: int, idle_ms: int):
        self.late_us, self.idle_ms = late_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "newest_us long, seen_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, seen_ms = self.clock.get() if self.clock.exists() else (-(2**63), 0)
        parts = [np.stack([r["came"].to_numpy(np.int64), r["ts"].to_numpy("datetime64[us]").astype(np.int64), r["arrived"].to_numpy("datetime64[us]").astype(np.int64)]) for r in rows]
        came, at, arrived = np.concatenate(parts, axis=1)
        order = np.lexsort((at, came))
        came, at = came[order], at[order]
        before = np.maximum.accumulate(np.append(newest, at))[:-1]
        late = (before > -(2**63)) & (at < before - self.late_us)
        latest = max(seen_ms, int(arrived.max()) // 1000)
        if latest > seen_ms:
            if seen_ms:
                self.handle.deleteTimer(seen_ms + self.idle_ms)
            self.handle.registerTimer(latest + self.idle_ms)
        self.clock.update((max(newest, int(at.max())), latest))
        for i in range(0, len(at), 10_000):
            some = slice(i, i + 10_000)
            yield pd.DataFrame({"session_id": key[0], "came": came[some], "ts": at[some].astype("datetime64[us]"), "late": late[some]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clock.clear()
        return iter(())

    def close(self) -> None:
        pass


def late_split(rows: DataFrame, minutes: int = 120, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """(session_id, came, ts, late) of a stream: a row is late if its session's clock had passed it by minutes when it came.

    rows: session_id, came (the order of arrival within a session, over all batches), ts, and arrived, the time of arrival, which has the watermark: by it no
    row is late, so none is lost, and the clocks of sessions from which nothing has come for idle_minutes are dropped.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    grouped = rows.withWatermark("arrived", "0 seconds").select("session_id", "came", "ts", "arrived").groupBy("session_id")
    return grouped.transformWithStateInPandas(statefulProcessor=LateState(minutes * 60_000_000, idle_minutes * 60_000), outputStructType=LATENESS, outputMode="Append", timeMode="EventTime")


def run_late(split: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Runs late_split() over what there is, into a table of the rows in time and one of the late rows; a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, late in (("timely", False), ("late", True)):
            batch.where(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{path}/{name}/n={number}")
        batch.unpersist()

    query = split.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = LATENESS.removesuffix(", late boolean") + ", n long"
    timely, late = (split.sparkSession.read.schema(schema).parquet(f"{path}/{name}").drop("n") for name in ("timely", "late"))
    return timely, late


def run_to_table(states: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is, each batch a folder of its own, so that a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number}")

    query = states.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return states.sparkSession.read.parquet(path)


def latest(table: DataFrame) -> DataFrame:
    """The last state of each session."""
    fields = [c for c in table.columns if c not in ("session_id", "batch", "n")]
    return table.groupBy("session_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("session_id", "s.*")


def announcements(table: DataFrame) -> DataFrame:
    """Each commit once: (session_id, commit_ts), whatever the number of observers and of batches that ran again."""
    return table.select("session_id", F.explode("announced").alias("commit_ts")).distinct()


def status(states: DataFrame, usual_nano_usd: Column) -> DataFrame:
    """What a status line shows: cost of the open task, its colour against the usual cost, and the carried share if it counts."""
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide("carried", "last_ctx"), F.lit(0.0)))
    cost = F.col("task_nano_usd")
    colour = F.when(cost > usual_nano_usd * RED, "red").when(cost > usual_nano_usd * AMBER, "amber").otherwise("plain")
    return states.select("session_id", "task_nano_usd", colour.alias("colour"), F.when(share >= SHOWN_SHARE, F.bround(share * 100, 0).cast("int")).alias("carried_percent"))


def bursts(requests: DataFrame) -> DataFrame:
    """Work bursts as session windows: a gap of IDLE ends one. Works on tables and, with a watermark, on streams."""
    w = F.session_window("ts", IDLE)
    return requests.groupBy("session_id", w.alias("w")).agg(F.count("*").alias("requests"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def spend(requests: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Spend by time window, tumbling or sliding."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return requests.groupBy(w.alias("w")).agg(F.sum("nano_usd").alias("nano_usd"), F.count("*").alias("requests")).select(F.col("w.start").alias("start_ts"), "nano_usd", "requests")


def tail(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The stream of ROWS in path's Parquet files, all that are there a batch or so many; rows later than LATE are beyond the watermark.

    A stream that is started again on its checkpoint goes on with the files it hasn't read. A file is read once, when it is there as a whole.
    """
    reader = spark.readStream.schema(ROWS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path).withWatermark("ts", LATE)


def _manifest(path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest manifest of a ledger (before a batch): its batch and the version of each part. Parts are LEDGER_PARTS at most."""
    fs, top = pyarrow.fs.FileSystem.from_uri(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/manifests", allow_not_found=True))
    numbers = [n for n in (int(f.base_name) for f in found if f.base_name.isdigit()) if before is None or n < before]
    if not numbers:
        return -1, {}
    with fs.open_input_stream(f"{top}/manifests/{max(numbers)}") as stream:
        return max(numbers), {int(p): v for p, v in json.loads(stream.read()).items()}


def _commit(path: str, number: int, parts: dict[int, int]) -> None:
    """Writes a manifest under another name, moves it into place, and removes what neither it nor the one before it names."""
    fs, top = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(f"{top}/manifests", recursive=True)
    with fs.open_output_stream(f"{top}/manifests/_{number}") as stream:
        stream.write(json.dumps(parts).encode())
    fs.move(f"{top}/manifests/_{number}", f"{top}/manifests/{number}")
    last, old = _manifest(path, number)
    named = {*parts.items(), *old.items()}
    for folder in fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/data", allow_not_found=True)):
        version = int(folder.base_name.removeprefix("v="))
        inside = fs.get_file_info(pyarrow.fs.FileSelector(folder.path))
        gone = [x for x in inside if x.base_name.startswith("part=") and (int(x.base_name.removeprefix("part=")), version) not in named]
        for x in gone:
            fs.delete_dir(x.path)
        if version < number and not any(v == version for _, v in named):
            fs.delete_dir(folder.path)
    for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/manifests")):
        if f.base_name.isdigit() and int(f.base_name) < last:
            fs.delete_file(f.path)


def _versions(spark: SparkSession, path: str, parts: dict[int, int], schema) -> DataFrame:
    """The rows of these versions of parts."""
    folders = [f"{path}/data/v={v}/part={p}" for p, v in sorted(parts.items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*folders)


def upsert_ledger(path: str):
    """A foreachBatch sink: the ledger under path gets each batch's receipts.

    The ledger is kept in parts by the hash of (repo, sha). A batch writes a new version of the parts that it touches, from what the manifest before
    it names, and then a manifest of its own, which makes them visible at once. A batch that runs again starts from the same manifest and writes the same
    again. Versions that neither of the last two manifests names are removed, so a reader has the time of a batch to read what it has opened.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = [c for c in batch.columns if c != "first_seen"] + ["first_seen"]
        part = F.pmod(F.xxhash64("repo", "sha"), F.lit(LEDGER_PARTS)).cast("int")
        new = batch.select(*fields).persist()
        touched = {r.part for r in new.where("seen_requests > 0").select(part.alias("part")).distinct().collect()}  # LEDGER_PARTS at most
        _, parts = _manifest(path, number)
        old = _versions(spark, path, {p: v for p, v in parts.items() if p in touched}, new.schema)
        if touched:
            merged = ledger_upsert(old, new).drop("changed").withColumn("part", part)
            merged.select(*fields, "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/v={number}")
        new.unpersist()
        _commit(path, number, parts | dict.fromkeys(touched, number))

    return put


def read_ledger(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The ledger that upsert_ledger keeps under path, as its newest manifest has it. schema: its columns, which a ledger without rows can't tell."""
    return _versions(spark, path, _manifest(path)[1], schema)


def run_ledger(receipts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream of receipts (repo, sha, requests, seen_requests, usd, first_seen) over what there is into the ledger under path."""
    query = receipts.writeStream.foreachBatch(upsert_ledger(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_ledger(receipts.sparkSession, path, receipts.schema)


def baseline(receipts: DataFrame) -> DataFrame:
    """One row: the median cost of a kept commit, or of any with work while fewer than five are kept."""
    return typical(receipts).select("usd", "commits")


def write_baseline(receipts: DataFrame, path: str, computed_at: datetime) -> None:
    """Adds the median of receipts to the table of baselines under path, one row for each time that it was computed; running again replaces the row."""
    baseline(receipts).write.mode("overwrite").parquet(f"{path}/at={int(computed_at.timestamp() * 1e6)}")


def read_baseline(spark: SparkSession, path: str, now: datetime, max_age: timedelta = BASELINE_AGE) -> tuple[float | None, bool]:
    """The newest usual cost in USD that was computed by now (None: there is none above zero), and whether it is older than max_age or absent."""
    rows = spark.read.schema("usd double, commits long, at long")
    fs, top = pyarrow.fs.FileSystem.from_uri(path)
    if fs.get_file_info(top).type == pyarrow.fs.FileType.NotFound:
        return None, True
    limit = int(now.timestamp() * 1e6)
    newest = rows.parquet(path).where(F.col("at") <= limit).agg(F.max_by(F.struct("at", "usd"), "at").alias("s")).first().s
    if newest is None:
        return None, True
    return newest.usd if newest.usd and newest.usd > 0 else None, limit - newest["at"] > max_age / timedelta(microseconds=1)


def run_status(states: DataFrame, path: str, checkpoint: str, baselines: str, refresh: Callable[[], DataFrame] | None = None, clock: Callable[[], datetime] | None = None, max_age: timedelta = BASELINE_AGE) -> DataFrame:
    """Runs a stream of STATE over what there is into a table of status rows (see status()), each batch a folder of its own.

    Every batch reads the baseline again. One that is too old is computed anew first, from the receipts that refresh gives; without refresh the old one stays in use.
    """
    spark = states.sparkSession
    clock = clock or (lambda: datetime.now(UTC))

    def put(batch: DataFrame, number: int) -> None:
        now = clock()
        usual, old = read_baseline(spark, baselines, now, max_age)
        if old and refresh:
            write_baseline(refresh(), baselines, now)
            usual, _ = read_baseline(spark, baselines, now, max_age)
        nano = F.lit(None).cast("long") if usual is None else F.lit(round(usual * 1e9))
        status(batch, nano).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number}")

    query = states.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
