"""What round 3 found: steps that gave one task too much, and work done several times."""

import json

from agentmeter.operators import runs as rn
from agentmeter.operators import uploads
from agentmeter.plans import QUERIES
from tests import test_uploads as given


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_task_takes_a_whole_setup(spark):
    rows = [(1, c, s, True, 10 * c, c) for c in range(20) for s in ("N", "A", "R")]
    runs = spark.createDataFrame(rows, "repo long, commit long, setup string, passed boolean, cents long, tokens long")
    pairs = spark.createDataFrame([("N-A", "N", "A"), ("N-R", "N", "R")], "id string, baseline string, challenger string")
    sums = rn.comparison_sums(runs, pairs)
    assert "hashpartitioning(setup" not in plan(sums) and sums.count() == 40


def test_files_alike_in_hash_are_looked_at_in_their_own_rows(spark):
    text = json.dumps(given.GOOD | {"runs": [given.RUN, given.RUN | {"setup": "two", "wh": [0.3, 0.2]}]})
    rows = [("a", "x", "x", 100, text, "a"), ("b", "x", "x", 100, text, "b")]
    files = spark.createDataFrame(rows, "submitter string, file_name string, sha256 string, size long, text string, author string")
    found = uploads.validate(files)
    assert [r.problems for r in found.collect()] == [["bad energy (runs 1)"]] * 2
    assert "Exchange" not in plan(found)  # nothing is gone through twice


def test_rules_of_uploads_and_records_shuffle_no_row_three_times(spark, sf):
    for name in ("o_q1_upload_validation", "o_q3_record_integrity"):
        assert "Expand" not in plan(QUERIES[name](spark, sf))


def test_one_shuffle_serves_both_windows_of_the_view(spark, sf):
    assert "hashpartitioning(sha256#" in (found := plan(QUERIES["o_q6_upload_view"](spark, sf)))
    assert not [line for line in found.splitlines() if "Exchange hashpartitioning(sha256" in line and "commit" in line.split("),")[0]]
