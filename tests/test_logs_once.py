"""Log lines are made, read and looked through once a query."""

import pytest

from agentmeter.plans import QUERIES
from agentmeter.sources import session_logs

BLOCK = "session_id string, cwd string, ts timestamp, type string, id string, name string, text string, tool_use_id string, input struct<command:string,file_path:string,notebook_path:string>"


@pytest.mark.parametrize("name", ["o_j20_call_intervals", "o_p9_touched_files"])
def test_lines_are_read_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # calls, and results


def test_lines_are_made_before_they_are_filtered(spark, sf):
    plan = QUERIES["o_s1_session_logs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "structstojson" in line.lower()]


def test_calls_and_files_of_odd_blocks(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02}"
    commit, rm = ("git commit -m x", None, None), ("rm -f c > d", None, None)
    rows = [
        ("s", "/r", at(5), "tool_use", "a", "Bash", None, None, commit), ("s", "/q", at(7), "tool_use", "a", "Bash", None, None, commit),  # a copy
        ("s", "/r", at(1), "tool_result", None, None, None, "a", None), ("s", "/r", at(9), "tool_result", None, None, None, "a", None), ("s", "/r", at(8), "tool_result", None, None, None, "a", None),
        ("s", "/r", at(5), "tool_use", None, "Bash", None, None, commit), ("s", "/r", at(6), "tool_result", None, None, None, None, None),  # without ids
        ("s", "/r", at(6), "tool_result", None, None, None, "z", None), ("s", "/r", at(1), "tool_use", "b", "Bash", None, None, rm), ("s", "/r", at(2), "tool_use", "c", "Bash", None, None, rm),
        ("s", "/r", at(3), "tool_use", "d", "Edit", None, None, (None, "e", None)), ("s", "/r", at(3), "tool_use", "e", "Edit", None, None, None),
    ]
    content = spark.createDataFrame(rows, BLOCK.replace("ts timestamp", "ts string")).withColumn("ts", session_logs.F.col("ts").cast("timestamp"))
    calls = [(r.cwd, r.start_ts.second, r.end_ts and r.end_ts.second) for r in session_logs.commit_calls(content).orderBy("end_ts").collect()]
    assert calls == [("/r", 5, None), ("/r", 5, 8)]
    assert sorted(r.path for r in session_logs.touched(content).collect()) == ["c", "d", "e"]
