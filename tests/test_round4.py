"""What round 4 found."""

import json

import duckdb
from pyspark.sql import functions as F

from agentmeter.operators import attribution as at
from agentmeter.operators import incremental, rollup, uploads
from tests import test_incremental as batches
from tests import test_uploads as given

WEIGHTS = [(54, 5, 12), (50, 9, 20), (9, 5, 18), (15, 7, 10), (9_000, 1, 36), (20_001, 1, 2), (8_192, 1, 3), (7, 1, 1)]


def test_counts_of_equal_weights_are_those_of_the_sql(spark):
    """Sums of many equal weights beside a half: as DuckDB rounds them, in however many parts Spark has them."""
    rows = [(0, i, 1, 100_000 * i + k, a / b, False, "fuzzy") for i, (n, a, b) in enumerate(WEIGHTS) for k in range(n)]
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE t (sha INTEGER, x DOUBLE)")
    for i, (n, a, b) in enumerate(WEIGHTS):
        con.execute("INSERT INTO t SELECT ?, ?::DOUBLE FROM range(?)", [i, a / b, n])
    want = [r[0] for r in con.execute("SELECT CAST(round_even(sum(x), 0) AS BIGINT) FROM t GROUP BY sha ORDER BY sha").fetchall()]
    df = spark.createDataFrame(rows, "repo long, sha long, session_id long, request_id long, weight double, lead_up boolean, tier string").repartition(7)
    measured = df.select("request_id", F.lit(1.0).alias("wh_low"), F.lit(2.0).alias("wh_high"), F.lit(3).cast("long").alias("nano_usd"))
    got = at.receipt(df, measured, df.select("repo", "sha", "tier").distinct()).orderBy("sha").collect()
    assert [r.requests for r in got] == want and want[0] == 23 and [r.seen for r in got] == [n for n, _, _ in WEIGHTS]


def test_counts_of_equal_weights_are_the_same_by_batches(spark, tmp_path):
    """54 requests of one session on two commits, 5 lines and 7: 22.5 and a bit are 23, wherever the batches are cut."""
    requests = [batches.request(i, 1, i) for i in range(54)]
    rows = {"ran": [(1, 0)], "touched": [(1, 0, "a")], "commits": [(0, s, batches.at_minute(60 + s), 1) for s in (5, 7)], "files": [(0, s, "a", s) for s in (5, 7)]}
    who, store = batches.people(spark, [1]), incremental.Store(spark, str(tmp_path / "store"))
    batches.add(spark, store, 0, {"requests": requests[:30], **rows}, who)
    batches.add(spark, store, 1, {"requests": requests[30:]}, who)
    want = []
    for lines in (5, 7):
        total = 0.0
        for _ in requests:
            total += lines / 12
        want.append((lines, round(total)))
    assert [(r.sha, r.requests) for r in store.receipts().orderBy("sha").collect()] == want and want[0][1] == 23


def test_exported_counts_are_those_of_the_sql(spark):
    rows = [(0, 1, 1, k, 5 / 12, False, "fuzzy") for k in range(54)]
    df = spark.createDataFrame(rows, "repo long, sha long, session_id long, request_id long, weight double, lead_up boolean, tier string").repartition(5)
    measured = df.select("request_id", F.lit(1.0).alias("wh_low"), F.lit(2.0).alias("wh_high"), F.lit(3).cast("long").alias("nano_usd"))
    receipt = at.receipt(df, measured, df.select("repo", "sha", "tier").distinct())
    commits = spark.createDataFrame([(0, 1, batches.at_minute(0), 1, "s")], "repo long, sha long, ts timestamp, author long, subject string")
    assert [r.ai_requests for r in rollup.export(receipt, commits, subjects=False).collect()] == [23]


def spoilt():
    """Uploads with one thing or two changed, as texts."""
    run, two = given.RUN, given.RUN | {"setup": "two"}
    runs = [[run, two]]
    for name in run:
        runs += [[run, {k: v for k, v in two.items() if k != name}]] + [[run, two | {name: x}] for x in (None, "x", "a\nb", 3, -1, 0.5, True, [], {}, [1, 2, 3, 4], [None, 1, 2, 3], [1.5, 2, 3, 4], [0.1, 0.2], [None, 0.2], ["1", 2, 3, 4], {"a": 1})]
    runs += [[run, None], [run, 3], [], [run, run], [run | {"odd key": 1}, two], [run | {"x: STRING, y": 1}, two], {"a": run}, None]
    heads = [given.GOOD | {"runs": r} for r in runs] + [given.GOOD | {"public": False, "runs": [r | {"commit": c} for r, c in zip((run, two), cs, strict=True)]} for cs in ((0, 0), (0, "0"), (1, -1), (1, 1.5), ("1", "1"))]
    good = given.GOOD | {"runs": runs[0]}
    for name in good:
        heads += [{k: v for k, v in good.items() if k != name}] + [good | {name: x} for x in (None, "x", 1, 0.5, -1, True, [], {}, {"name": "two"}, {"name": None}, {"answer": "SUPPORTED", "cost_ratio": -1}, {"answer": None, "energy": 1}, {"energy": {}}, {"agentmeter": "1" * 41}, {"codex": 3}, {"shell": "z"})]
    heads += [good | x for x in ({"affiliation": "a‮b"}, {"affiliation": "a\x7fb"}, {"affiliation": "a\x01b"}, {"affiliation": "grün"}, {"affiliation": "http://a.b"}, {"repo": "x"}, {"repo": "x", "public": False}, {"x": {"runs": [run]}}, {"a b": 1}, {"public": False, "affiliation": "a" * 40}, {"public": False, "affiliation": "https://a.b"})]
    texts = [json.dumps(h, ensure_ascii=ascii_) for h in heads for ascii_ in (True, False)]
    base = json.dumps(good)
    return texts + ["", "null", "[]", "{}", base + " ‮", base.replace("{", "{\r\n", 1), base.replace('"repeat": 0', '"repeat": -0'), base.replace('"wall_s": ', '"wall_s": 1e400, "x": ', 1), base.replace('"wall_s": ', '"wall_s": 1e400, "wall_s": ', 1), base[:-1]]


def test_files_of_declared_types_are_told_the_same(spark, monkeypatch):
    """Files read as structs against the same files looked at value by value."""
    rows = [("a", str(i), str(i), 100, text, "a") for i, text in enumerate(spoilt())]
    files = spark.createDataFrame(rows, "submitter string, file_name string, sha256 string, size long, text string, author string").repartition(4)
    got = {r.sha256: r.problems for r in uploads.validate(files).collect()}
    for name in ("STRICT_HEAD", "PLAIN_HEAD", "PLAIN_RUNS", "PRIVATE_RUNS"):
        monkeypatch.setattr(uploads, name, "^none$")
    want = {r.sha256: r.problems for r in uploads.validate(files).collect()}
    assert {i: (rows[int(i)][4], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert len(want) == len(rows) > 500 and len({tuple(p) for p in want.values()}) > 30


def test_good_files_are_read_as_structs(spark):
    """And those that only look like them by the names of their keys aren't."""
    good = given.GOOD | {"runs": [given.RUN, given.RUN | {"setup": "two"}]}
    near = [good | {"x: STRING, week": "x"}, good | {"home": "x"}, {k: v for k, v in good.items() if k != "runs"} | {"x": {"runs": good["runs"]}}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([good, *near])], "i int, text string").withColumn("k", F.schema_of_variant(F.try_parse_json("text")))
    found = df.select(F.col("k").rlike(uploads.STRICT_HEAD).alias("strict"), F.col("k").rlike(uploads.PLAIN_HEAD).alias("head"), F.col("k").rlike(uploads.PLAIN_RUNS).alias("runs")).collect()
    assert [tuple(r) for r in found] == [(True, True, True), (False, False, False), (False, True, True), (False, False, False)]
