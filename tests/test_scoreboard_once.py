"""The scoreboard and its tiers go through records once, whatever the number of reruns."""

from pyspark.sql import functions as F

from agentmeter.operators import trust
from agentmeter.plans import QUERIES

COLUMNS = "sha256 string, submitter string, baseline string, challenger string, task_mode string, public boolean, rerun_of string, key string, answer string, week string, repo_id string, n_runs long, cost_ratio double, solve_diff double"


def record(sha, submitter, answer="SUPPORTED", rerun_of=None, key="k", public=True, repo="r", n_runs=2, challenger="b"):
    return (sha, submitter, "a", challenger, "hint", public, rerun_of, key, answer, "2024-W10", repo, n_runs, 1.0, 0.0)


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_tiers_of_all_kinds(spark):
    rows = [
        record("own", "s1"), record("own1", "s1", rerun_of="own"),  # one's own rerun says nothing
        record("alike", "s1"), record("alike1", "s0", rerun_of="alike"), record("alike2", "s1", "NOT SUPPORTED", rerun_of="alike"),  # only the other submitter counts
        record("other", "s1"), record("other1", "s1", rerun_of="other"), record("other2", "s2", "NOT SUPPORTED", rerun_of="other"),
        record("middle", "s5"), record("middle1", "s1", rerun_of="middle"), record("middle2", "s5", rerun_of="middle"), record("middle3", "s9", rerun_of="middle"),
        record("key", "s1"), record("key1", "s2", rerun_of="key", key="l"), record("hidden", "s1", public=False), record("hidden1", "s2", rerun_of="hidden"),
        record("shy", "s1"), record("shy1", "s2", rerun_of="shy", public=False), record("silent", "s1"), record("silent1", "s2", None, rerun_of="silent"), record("lost1", "s1", rerun_of="nowhere"),
    ]
    got = {r.sha256: r.tier for r in trust.tiers(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert len(got) == len(rows) and {t for s, t in got.items() if s[-1].isdigit()} == {"rerun"}
    assert {s: t for s, t in got.items() if not s[-1].isdigit()} == {
        "own": "self-reported", "alike": "reproduced", "other": "disputed", "middle": "reproduced", "key": "self-reported", "hidden": "self-reported", "shy": "self-reported", "silent": "self-reported",
    }


def test_a_board_counts_each_submitter_once(spark):
    rows = [record(f"x{s}{r}", f"s{s}", repo=f"r{r}", n_runs=s + r) for s in range(4) for r in range(3)] + [record("y", "s1", challenger="c")]
    tiered = spark.createDataFrame(rows, COLUMNS).withColumn("tier", F.lit("self-reported"))
    board = {r.challenger: r for r in trust.scoreboard(tiered, spark.createDataFrame([], "challenger string, submitter string")).collect()}
    assert (board["b"].repos, board["b"].submitters, board["b"].shown) == (12, 4, True)  # 12 of 30 runs are of one submitter
    assert (board["c"].repos, board["c"].submitters, board["c"].shown) == (1, 1, False)


def test_records_are_gone_through_once(spark, sf):
    found = plan(QUERIES["o_a27_scoreboard"](spark, sf))
    scans = [line for line in found.splitlines() if "FileScan parquet" in line and "o_orderkey" in line]
    assert len(scans) == 2  # all records, and those that rerun others
