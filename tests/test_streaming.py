"""The live stream: state and its expiry, late rows, the ledger's versions, and baselines that change in the middle."""

import os
import random
import tracemalloc
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from agentmeter.operators.rollup import ledger_upsert
from agentmeter.streaming import live

START = datetime(2024, 3, 1, tzinfo=UTC)


def at(minutes):
    return START + timedelta(minutes=minutes)


class Handle:
    """The stores of one session, kept in memory."""

    def __init__(self):
        self.timers, self.stores = set(), {}

    def getMapState(self, name, *_):
        return self.stores.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.stores.setdefault(name, Value())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Map:
    def __init__(self):
        self.held = {}

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def values(self):
        return iter(self.held.values())

    def clear(self):
        self.held.clear()


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


def frame(rows):
    columns = ["session_id", "ts", "kind", "request_id", "output", "nano_usd", "ctx", "is_sidechain"]
    df = pd.DataFrame(rows, columns=columns)
    df["ts"] = pd.to_datetime(df["ts"], unit="us")
    return df


def plain_states(batches):
    """Row by row, each batch in order."""
    task, base, last, after, commit, commits = {}, 0, 0, 0, -1, 0
    for rows in batches:
        announced = []
        for _, us, kind, rid, output, nano, ctx, side in sorted(rows, key=lambda r: (r[1], r[2] == "commit", r[3] or 0, r[4] or 0)):
            if kind == "commit":
                if commit < 0 or commit < us - live.GUARD_US:
                    commit, commits, after = us, commits + 1, 0
                    announced.append(us)
                    task = {}
                continue
            if rid not in task or task[rid][0] < output:
                task[rid] = (output, nano)
            if not side:
                last, base = ctx, base or ctx
                after = after or (ctx if commits else 0)
        yield sum(n for _, n in task.values()), len(task), commits, base, last, max(0, after - base) if commits else 0, announced


@pytest.mark.parametrize("seed", range(25))
def test_states_equal_a_walk_in_order(seed):
    """Whatever the order and the parts in which a batch's rows come."""
    draw = random.Random(seed)
    batches = []
    for b in range(4):
        rows = []
        for _ in range(draw.randrange(1, 60)):
            us = (b * 900 + draw.randrange(900)) * 1_000_000
            if draw.random() < 0.15:
                rows.append((1, us, "commit", None, None, None, None, None))
            else:
                rid, output = draw.randrange(30), draw.randrange(1, 9)
                rows.append((1, us, "request", rid, output, rid * 100 + output, draw.choice([0, draw.randrange(1, 500)]), draw.random() < 0.3))
        batches.append(rows)
    state = live.LiveState(60_000)
    state.init(Handle())
    for rows, want in zip(batches, plain_states(batches), strict=True):
        mixed = draw.sample(rows, len(rows))
        cut = sorted(draw.randrange(len(mixed) + 1) for _ in range(3))
        parts = [p for p in (mixed[: cut[0]], mixed[cut[0] : cut[1]], mixed[cut[1] : cut[2]], mixed[cut[2] :]) if p]
        (got,) = state.handleInputRows((1,), map(frame, parts), None)
        row = got.iloc[0]
        assert (row.task_nano_usd, row.task_requests, row.commits, row.base_ctx, row.last_ctx, row.carried) == want[:-1]
        assert [int(t.value // 1000) for t in row.announced] == want[-1]


def test_a_hot_session_needs_numbers_not_frames():
    """Two million rows in one batch, a commit now and then: what is kept are the rows after the last one."""

    def parts():
        draw = np.random.default_rng(1)
        for i in range(200):
            n = 10_000
            kind = np.where(np.arange(n) == 5000, "commit", "request")
            ts = pd.to_datetime((i * n + draw.permutation(n)) * 1_000_000, unit="us")
            yield pd.DataFrame({"session_id": 1, "ts": ts, "kind": kind, "request_id": i * n + np.arange(n), "output": 1, "nano_usd": 2, "ctx": 3, "is_sidechain": False})

    state = live.LiveState(60_000)
    state.init(Handle())
    tracemalloc.start()
    (got,) = state.handleInputRows((1,), parts(), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.iloc[0].commits > 150 and got.iloc[0].task_requests < 20_000
    assert peak < 100e6


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_idle_sessions_are_dropped_and_begin_anew(spark, tmp_path):
    row = lambda session, minute, ctx, kind="request": (session, at(minute), kind, 1 if kind == "request" else None, 1, 5, ctx, False)
    inside, sizes = str(tmp_path / "in"), []
    for rows in ([row(1, 0, 100), row(1, 1, 0, "commit"), row(2, 1, 7)], [row(2, 600, 9)], [row(2, 601, 9)], [row(1, 620, 300)]):
        write(spark, rows, live.ROWS, inside)
        states = live.live_states(live.tail(spark, inside, 1), idle_minutes=60)
        query = states.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")).option("checkpointLocation", str(tmp_path / "check")).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    table = spark.read.parquet(f"{tmp_path}/out").orderBy("n")
    mine = [(r.commits, r.base_ctx, r.last_ctx) for r in table.where("session_id = 1").collect()]
    assert mine == [(1, 100, 100), (0, 300, 300)]
    assert min(sizes[1:3]) < sizes[0]


LATE = "session_id long, came long, ts timestamp, arrived timestamp"


def test_late_rows_land_in_a_table_of_their_own(spark, tmp_path):
    inside, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    row = lambda session, came, minute: (session, came, at(minute), at(came))
    batches = [[row(1, 1, 300), row(1, 2, 100), row(1, 3, 180), row(2, 4, 10), row(1, 5, 500)], [row(1, 6, 379), row(1, 7, 380), row(2, 8, 5)]]
    for rows in batches:
        random.Random(1).shuffle(rows)
        write(spark, rows, LATE, inside)
        timely, late = live.run_late(live.late_split(spark.readStream.schema(LATE).parquet(inside)), out, check)
    assert {(r.session_id, r.came) for r in late.collect()} == {(1, 2), (1, 6)}
    assert {(r.session_id, r.came) for r in timely.collect()} == {(1, 1), (1, 3), (2, 4), (1, 5), (1, 7), (2, 8)}


def test_clocks_of_idle_sessions_are_dropped(spark, tmp_path):
    inside, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    row = lambda session, came, minute: (session, came, at(minute), at(came))
    for rows in ([row(1, 1, 900), row(2, 1, 900)], [row(2, 500, 901)], [row(2, 501, 902)], [row(1, 502, 10), row(2, 502, 10)]):
        write(spark, rows, LATE, inside)
        timely, late = live.run_late(live.late_split(spark.readStream.schema(LATE).parquet(inside), idle_minutes=60), out, check)
    assert [(r.session_id, r.came) for r in late.collect()] == [(2, 502)]  # session 1 had no clock any more
    assert timely.count() == 5


RECEIPTS = "repo string, sha string, requests long, seen_requests long, usd double, first_seen long"


def receipts(spark, *rows):
    return spark.createDataFrame(rows, RECEIPTS)


def test_several_receipts_of_a_commit_in_one_batch_leave_one_row(spark):
    old = receipts(spark, ("r", "a", 7, 7, 0.7, 3), ("r", "b", 1, 1, 0.1, 3))
    new = receipts(spark, ("r", "a", 5, 5, 0.5, 4), ("r", "b", 5, 5, 0.5, 9), ("r", "b", 9, 9, 0.9, 4), ("r", "c", 2, 2, 0.2, 8), ("r", "c", 1, 1, 0.1, 5), ("r", "d", 0, 0, 0.0, 4))
    got = {r.sha: (r.requests, r.usd, r.first_seen, r.changed) for r in ledger_upsert(old, new).collect()}
    assert got == {"a": (7, 0.7, 3, False), "b": (9, 0.9, 3, True), "c": (2, 0.2, 5, True)}


def folders(path):
    return sorted(f"{v}/{p}" for v in os.listdir(f"{path}/data") for p in os.listdir(f"{path}/data/{v}") if p.startswith("part="))


def test_old_versions_are_removed_and_a_batch_may_run_again(spark, tmp_path):
    path = str(tmp_path)
    put = live.upsert_ledger(path)
    rows = lambda n: receipts(spark, ("r", "a", n, n, n / 10, n), ("r", "a", n - 1, n - 1, 0.0, n))
    for n in range(1, 7):
        put(rows(n), n - 1)
        assert [(r.requests, r.first_seen) for r in live.read_ledger(spark, path).collect()] == [(n, 0 + 1)]
        assert len(folders(path)) <= 2 and len([m for m in os.listdir(f"{path}/manifests") if m.isdigit()]) <= 2
    put(rows(6), 5)  # the last batch runs again, whole
    assert [(r.requests, r.first_seen) for r in live.read_ledger(spark, path).collect()] == [(6, 1)]
    put(receipts(spark, ("r", "z", 0, 0, 0.0, 1)), 6)  # a batch that touches nothing
    put(receipts(spark, *[("q", f"s{i}", 1, 1, 0.1, 9) for i in range(300)]), 7)
    got = live.read_ledger(spark, path, rows(1).schema)
    assert got.count() == 301 and got.where("sha = 'a'").first().requests == 6
    assert live.read_ledger(spark, str(tmp_path / "none"), RECEIPTS).count() == 0


def test_a_batch_that_failed_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    put = live.upsert_ledger(path)
    put(receipts(spark, ("r", "a", 1, 1, 0.1, 1)), 0)
    monkeypatch.setattr(live, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        put(receipts(spark, ("r", "a", 5, 5, 0.5, 2)), 1)
    assert live.read_ledger(spark, path).first().requests == 1
    monkeypatch.undo()
    put(receipts(spark, ("r", "a", 5, 5, 0.5, 2)), 1)
    assert live.read_ledger(spark, path).first().requests == 5


def worked(spark, *usd):
    return spark.createDataFrame([(u, 1.0, 2.0, "kept", 1) for u in usd], "usd double, wh_low double, wh_high double, status string, seen long")


def test_colours_follow_a_baseline_that_is_refreshed_in_the_middle(spark, tmp_path):
    inside, base = str(tmp_path / "in"), str(tmp_path / "base")
    now, asked = [at(0)], []
    live.write_baseline(worked(spark, 1e-9, 10e-9, 200e-9), base, at(0))

    def refresh():
        asked.append(now[0])
        return worked(spark, 1e-9)

    row = lambda minute: (1, at(minute), "request", 1, 1, 20, 5, False)
    colours = []
    for minute in (1, 60, 24 * 60, 24 * 60 + 1, 24 * 60 + 2):
        now[0] = at(minute)
        write(spark, [row(minute)], live.ROWS, inside)
        table = live.run_status(live.live_states(live.tail(spark, inside, 1)), str(tmp_path / "out"), str(tmp_path / "check"), base, refresh, lambda: now[0])
        colours.append(live.latest(table).first().colour)
    assert colours == ["amber", "amber", "amber", "red", "red"] and asked == [at(24 * 60 + 1)]
    assert live.read_baseline(spark, base, at(5)) == (10e-9, False)  # older versions stay
    assert live.read_baseline(spark, base, at(5) + timedelta(days=3)) == (1e-9, True)


def test_baselines_that_are_absent_or_zero(spark, tmp_path):
    base = str(tmp_path / "base")
    assert live.read_baseline(spark, base, at(0)) == (None, True)
    live.write_baseline(worked(spark, 0.0), base, at(0))
    assert live.read_baseline(spark, base, at(1)) == (None, False)
    assert live.read_baseline(spark, base, at(-1)) == (None, True)
    assert live.status(spark.createDataFrame([(1, 50, 3, 9)], "session_id long, task_nano_usd long, carried long, last_ctx long"), live.F.lit(None).cast("long")).first().colour == "plain"
