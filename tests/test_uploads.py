"""Uploads as raw JSON, and hashes of private records."""

import json
import re

import pytest

from agentmeter.operators import trust, uploads
from agentmeter.operators.transcripts import SCRIPT_EXPORT

RUN = {"commit": "a" * 40, "setup": "one", "repeat": 0, "outcome": "passed", "passed": True, "model": None, "agent": "claude", "cost_known": True, "cost_usd": 0.5, "wall_s": 3, "tokens": [1, 2, 3, 4], "wh": [0.1, 0.2], "requests": "1-5", "tokens_check": "ok"}
GOOD = {
    "usage_upload": 1, "kind": "verify", "week": "2026-W40", "claim_kind": "model", "task_mode": "hint", "public": True, "repo_id": "b" * 24, "versions": {"prices": "2"}, "baseline": {"name": "one"}, "challenger": {"name": "two"},
    "runs": [RUN, RUN | {"setup": "two"}], "verdict": {"answer": "NOT PROVEN", "cost_ratio": None, "energy": None}, "superseded_attempts": 0, "excluded_commits": 0, "rerun_of": None, "affiliation": None,
}
CASES = [
    ({}, []),
    ({"home": "x"}, ["other fields"]),
    ({"public": "yes"}, ["public isn't said", "private record with address or commit", "commit isn't of its kind (runs 0, 1)"]),
    ({"repo": "r"}, []),
    ({"versions": {"shell": "x"}}, ["versions"]),
    ({"versions": {"prices": 2}}, ["versions"]),
    ({"versions": {"prices": "2" * 41}}, ["versions"]),
    ({"versions": None}, ["versions"]),
    ({"week": "2026-40"}, ["week"]),
    ({"superseded_attempts": True}, ["counts"]),
    ({"superseded_attempts": 1.5}, ["counts"]),
    ({"excluded_commits": -1}, ["counts"]),
    ({"affiliation": "a‮b"}, ["control characters"]),
    ({"affiliation": 7}, ["affiliation"]),
    ({"repo_id": None}, []),
    ({"repo_id": "B" * 24}, ["repo_id"]),
    ({"rerun_of": "c" * 64}, []),
    ({"rerun_of": "c" * 63}, ["rerun_of"]),
    ({"claim_kind": "idea"}, ["claim or task mode"]),
    ({"verdict": {"answer": "YES"}}, ["answer"]),
    ({"verdict": {"answer": "SUPPORTED", "cost_ratio": "0.5"}}, ["cost ratio"]),
    ({"verdict": {"answer": "SUPPORTED", "energy": {"verdict": 3}}}, ["energy verdict"]),
    ({"verdict": None}, ["verdict must be an object"]),
    ({"baseline": "one"}, ["sides must be objects"]),
    ({"runs": []}, ["no runs"]),
    ({"runs": [RUN]}, ["incomplete"]),
    ({"runs": [RUN, RUN, RUN | {"setup": "two"}]}, ["duplicate run"]),
    ({"runs": [RUN, RUN | {"setup": "three"}]}, ["setup of neither side (runs 1)", "incomplete"]),
    ({"kind": "other"}, ["not an upload"]),
    ({"usage_upload": "1"}, ["not an upload"]),
]
RUNS = [
    ("note", "x", "other fields"), ("outcome", "lost", "unknown outcome"), ("passed", 1, "passed doesn't match outcome"), ("agent", None, "agent or model"), ("model", 3, "agent or model"), ("cost_known", "true", "bad cost"), ("cost_usd", "0.5", "bad cost"), ("cost_usd", True, "bad cost"),
    ("cost_usd", -0.1, "bad cost"), ("wall_s", None, "bad wall time or repeat"), ("repeat", 0.5, "bad wall time or repeat"), ("tokens", [1, 2, 3], "bad tokens"), ("tokens", [1, 2, 3, 4.5], "bad tokens"), ("tokens", [1, 2, 3, "4"], "bad tokens"), ("tokens", None, None), ("wh", [2, 1], "bad energy"),
    ("wh", [0, "1"], "bad energy"), ("wh", None, None), ("requests", "7", "requests or tokens check"), ("requests", None, None), ("tokens_check", None, "requests or tokens check"), ("commit", 3, "commit isn't of its kind"),
]


def checked(spark, texts):
    rows = [("ann", str(i), str(i), len(t), t, "ann") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "submitter string, file_name string, sha256 string, size long, text string, author string")
    found = {int(r.sha256): r.problems for r in uploads.validate(df).collect()}
    return [found[i] for i in range(len(texts))]


def test_heads_and_sets(spark):
    texts = [json.dumps(GOOD | change) for change, _ in CASES]
    texts += ["{", json.dumps(GOOD)[:-1] + ',"week":"2026-W41"}', json.dumps([GOOD]), json.dumps(GOOD).replace("0.5", "NaN")]
    private = GOOD | {"public": False, "runs": [r | {"commit": 0} for r in GOOD["runs"]]}
    texts += [json.dumps(private | x) for x in ({}, {"repo": "r"}, {"baseline": {"name": "one", "command": "x"}}, {"rerun_of": "c" * 64}, {"affiliation": "http://x"}, {"repo_id": None})]
    want = [w for _, w in CASES] + [["not JSON"], ["not JSON"], ["not an upload"], ["not JSON"], [], ["other fields"], ["private side's fields"], ["rerun_of"], ["private record with address or commit"], ["repo_id"]]
    for text, a, b in zip(texts, checked(spark, texts), want, strict=True):
        assert a == b, text


def test_rules_of_runs_name_their_places(spark):
    changed = [GOOD | {"runs": [RUN, RUN | {"setup": "two", name: value}]} for name, value, _ in RUNS]
    for (name, value, rule), got in zip(RUNS, checked(spark, [json.dumps(x) for x in changed]), strict=True):
        shown = [p for p in got if p not in ("incomplete", "unknown")]
        first = [p for p in shown if rule and p.startswith(rule)]
        assert (first == [f"{rule} (runs 1)"]) if rule else (got == []), (name, value, got)


@pytest.mark.parametrize("same", [True, False])
def test_private_commits_have_a_hash_in_each_record(spark, same):
    records = spark.createDataFrame([("r1", False), ("r2", False), ("r3", True)], "sha256 string, public boolean")
    runs = spark.createDataFrame([(r, "c1", "one") for r in ("r1", "r2", "r3")] + [("r1", "c1", "two")], "sha256 string, commit string, setup string")
    attempts = excluded = runs.where("setup = 'one'").select("sha256", "commit")
    got = {r.sha256: r for r in trust.record(records, runs, attempts, excluded, "secret" if same else "other").collect()}
    mine = {k: {x.commit for x in [*r.runs, *r.superseded_attempts, *r.excluded_commits]} for k, r in got.items()}
    assert mine["r3"] == {"c1"} and len(mine["r1"]) == len(mine["r2"]) == 1 and mine["r1"] != mine["r2"]


def test_one_side_alone_is_incomplete(spark):
    head = spark.createDataFrame([("u", 1, "u", "a", "a", True, "b" * 24, "one", "two", "2026-W01", None, None, "model", "hint", 0, 0, "SUPPORTED", None)], "sha256 string, size long, file_name string, author string, submitter string, public boolean, repo_id string, baseline string, challenger string, week string, affiliation string, rerun_of string, claim_kind string, task_mode string, superseded_attempts int, excluded_commits int, answer string, cost_ratio double")
    run = spark.createDataFrame([("u", "a" * 40, "one", 0, "passed", True, 1.0, 1.0, [1, 1, 1, 1], [0.1, 0.2], "1-5")], "sha256 string, commit string, setup string, repeat int, outcome string, passed boolean, cost_usd double, wall_s double, tokens array<long>, wh array<double>, requests string")
    assert trust.validated(head, run).first().problems == ["incomplete"]


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("export default async function go() {", "go"), ("export function* gen() {", "gen"), ("export abstract class A {", "A"), ("export const enum E {", "E"), ("export * as ns from './x'", "ns"),
        ("export declare const y: number", "y"), ("export namespace N {", "N"), ("export type T = 1", "T"), ("export { x }", None), ("export default 3", None),
    ],
)
def test_export_forms(line, name):
    found = re.findall(SCRIPT_EXPORT, line)
    assert found == ([name] if name else [])
