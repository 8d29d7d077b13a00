"""Queries on published records. Records are made of orders and their lines: one upload an order, its lines are the runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.operators import trust
from agentmeter.operators import uploads as upload_ops
from agentmeter.plans.registry import PIECES, query
from agentmeter.plans.rollup import rounded

PIECES["sides"] = """SELECT o_orderkey AS n, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, 's' || (o_custkey % 12) AS submitter, 'claude-code' AS baseline, CASE WHEN (o_orderkey - CAST(o_orderkey % 34 = 0 AS INTEGER)) % 23 = 0 THEN 'custom' ELSE 'claude-code@m' || ((o_orderkey - CAST(o_orderkey % 34 = 0 AS INTEGER)) % 4) END AS challenger, strftime(o_orderdate, '%G-W%V') AS week,
    o_orderkey % 5 <> 0 AS public, CASE WHEN o_orderkey % 17 = 0 THEN sha256(CAST(o_orderkey - 1 AS VARCHAR)) END AS rerun_of, 'hint' AS task_mode FROM orders"""
PIECES["upload_runs"] = """SELECT s.sha256, s.n, l_linenumber AS pos, l_partkey % 50 AS commit, CASE WHEN l_returnflag = 'N' THEN s.baseline ELSE s.challenger END AS setup, l_returnflag = 'N' AS is_base, l_linestatus = 'F' AS passed, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity * 100 AS BIGINT) AS tokens
    FROM (SELECT * FROM lineitem WHERE l_orderkey % 34 <> 0 UNION ALL SELECT * REPLACE (l_orderkey + 1 AS l_orderkey, CASE WHEN l_orderkey % 68 = 33 AND l_returnflag <> 'N' THEN l_extendedprice * 3 ELSE l_extendedprice END AS l_extendedprice) FROM lineitem WHERE l_orderkey % 34 = 33) JOIN sides s ON s.n = l_orderkey"""
PIECES["uploads"] = """SELECT s.*, substr(md5('r' || coalesce(r.repo, 0)), 1, 24) AS repo_id, coalesce(r.n_runs, 0) AS n_runs, c_per / b_per AS cost_ratio, coalesce(c_rate, 0) - coalesce(b_rate, 0) AS solve_diff, b_per, c_per, b_rate, c_rate, coalesce(c_solved, 0) AS c_solved,
    CASE WHEN c_per / b_per <= 0.9 THEN 'SUPPORTED' WHEN c_per / b_per >= 1.1 THEN 'NOT SUPPORTED' ELSE 'NOT PROVEN' END AS answer FROM sides s LEFT JOIN (
    SELECT n, count(*) AS n_runs, min(commit) AS repo, CASE WHEN count(*) FILTER (is_base AND passed) > 0 THEN sum(cents) FILTER (is_base) / count(*) FILTER (is_base AND passed) END AS b_per, CASE WHEN count(*) FILTER (NOT is_base AND passed) > 0 THEN sum(cents) FILTER (NOT is_base) / count(*) FILTER (NOT is_base AND passed) END AS c_per,
      CASE WHEN count(*) FILTER (is_base) > 0 THEN count(*) FILTER (is_base AND passed) / count(*) FILTER (is_base) END AS b_rate, CASE WHEN count(*) FILTER (NOT is_base) > 0 THEN count(*) FILTER (NOT is_base AND passed) / count(*) FILTER (NOT is_base) END AS c_rate, count(*) FILTER (NOT is_base AND passed) AS c_solved
    FROM upload_runs GROUP BY n) r ON r.n = s.n"""


def _sha(k):
    return F.sha2(k.cast("string").cast("binary"), 256)


def _challenger(k):
    of = k - (k % 34 == 0).cast("int")  # every 34th order runs again what the one before it ran
    return F.when(of % 23 == 0, "custom").otherwise(F.concat(F.lit("claude-code@m"), (of % 4).cast("string")))


def _named(orders, *more):
    """What orders (n, o_custkey, o_orderdate) say of their uploads, and their columns more. Hashes and names are long and made last, so that joins by the order's number go without them."""
    from agentmeter.operators.rollup import iso_week

    k = F.col("n")
    return orders.select(
        k, _sha(k).alias("sha256"), F.concat(F.lit("s"), (F.col("o_custkey") % 12).cast("string")).alias("submitter"), F.lit("claude-code").alias("baseline"),
        _challenger(k).alias("challenger"), iso_week(F.col("o_orderdate").cast("timestamp")).alias("week"), (k % 5 != 0).alias("public"),
        F.when(k % 17 == 0, _sha(k - 1)).alias("rerun_of"), F.lit("hint").alias("task_mode"), *more,
    )


def _orders(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), "o_custkey", "o_orderdate")


def sides(spark, sf_dir):
    return _named(_orders(spark, sf_dir))


def _lines(spark, sf_dir):
    """Runs by their order's number, of orders that are there or not."""
    base = F.col("l_returnflag") == "N"
    line = fx.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "n")
    dearer = F.when((F.col("n") % 68 == 33) & ~base, F.col("l_extendedprice") * 3).otherwise(F.col("l_extendedprice"))
    line = line.where("n % 34 <> 0").unionByName(line.where("n % 34 = 33").withColumns({"l_extendedprice": dearer, "n": F.col("n") + 1}))
    return line.select(
        "n", F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 50).alias("commit"), base.alias("is_base"), (F.col("l_linestatus") == "F").alias("passed"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), (F.col("l_quantity") * 100).cast("long").alias("tokens"),
    )


def upload_runs(spark, sf_dir):
    """The runs of orders that are there. Only numbers are shuffled; hashes and names, which follow from the order's number, are made after the join."""
    n = F.col("n")
    setup = F.when(F.col("is_base"), F.lit("claude-code")).otherwise(_challenger(n))
    return _lines(spark, sf_dir).join(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")), "n").select(_sha(n).alias("sha256"), "n", "pos", "commit", setup.alias("setup"), "is_base", "passed", "cents", "tokens")


def uploads(spark, sf_dir, **more):
    """Uploads with what their runs come to; more: further columns, of runs. Lines go to their order as they are: its few lines lie apart, so sums of each task would be longer."""
    b, c, p = F.col("is_base"), ~F.col("is_base"), F.col("passed")
    cost = lambda side: F.try_divide(F.sum(F.when(side, F.col("cents"))), F.count_if(side & p))
    rate = lambda side: F.try_divide(F.count_if(side & p), F.count_if(side))
    g = _lines(spark, sf_dir).repartition("n").groupBy("n").agg(
        F.count("*").alias("n_runs"), F.min("commit").alias("repo"), cost(b).alias("b_per"), cost(c).alias("c_per"), rate(b).alias("b_rate"), rate(c).alias("c_rate"), F.count_if(c & p).alias("c_solved"),
        *[x.alias(name) for name, x in more.items()],
    )
    ratio = F.col("c_per") / F.col("b_per")
    found = _orders(spark, sf_dir).join(g, "n", "left")
    j = _named(found, *[x for x in g.columns if x != "n"]).withColumns({"cost_ratio": ratio, "solve_diff": F.coalesce("c_rate", F.lit(0.0)) - F.coalesce("b_rate", F.lit(0.0)), "n_runs": F.coalesce("n_runs", F.lit(0)), "c_solved": F.coalesce("c_solved", F.lit(0))})
    repo = F.substring(F.md5(F.concat(F.lit("r"), F.coalesce("repo", F.lit(0)).cast("string"))), 1, 24)
    return j.withColumns({"repo_id": repo, "answer": F.when(F.col("cost_ratio") <= 0.9, "SUPPORTED").when(F.col("cost_ratio") >= 1.1, "NOT SUPPORTED").otherwise("NOT PROVEN")}).drop("repo")


# What is wrong with an upload, by its number: each rule is broken by some.
PIECES["upload_problems"] = """SELECT n, sha256, list_filter([CASE WHEN n % 29 = 0 THEN 'too large' END, CASE WHEN n % 31 = 0 THEN 'file name isn''t the hash' END, CASE WHEN NOT public AND n % 37 = 0 THEN 'private record with address or commit' END, CASE WHEN n % 41 = 0 THEN 'week' END,
    CASE WHEN rerun_of IS NOT NULL AND NOT public THEN 'rerun_of' END, CASE WHEN n % 43 = 0 THEN 'counts' END], lambda x: x IS NOT NULL) AS head FROM uploads"""
PIECES["run_problems"] = """SELECT sha256, list_sort(list_distinct(flatten(list(broken)))) AS broken, max(n) AS most, count(*) AS keys, count(DISTINCT commit) * 2 * count(DISTINCT repeat) AS full_ FROM (
    SELECT sha256, commit, setup, repeat, count(*) AS n, flatten(list(list_filter([CASE WHEN tokens % 900 = 0 THEN 'bad cost' END, CASE WHEN cents % 10 = 3 THEN 'unknown outcome' END, CASE WHEN cents % 10 = 3 AND passed THEN 'passed doesn''t match outcome' END], lambda x: x IS NOT NULL))) AS broken
    FROM (SELECT *, pos % 2 AS repeat FROM upload_runs) GROUP BY ALL) GROUP BY sha256"""


@query("o_q1_upload_validation", "SELECT p.sha256, array_to_string(list_concat(head, CASE WHEN r.sha256 IS NULL THEN ['no runs'] ELSE list_concat(broken, list_filter([CASE WHEN most > 1 THEN 'duplicate run' END, CASE WHEN keys < full_ THEN 'incomplete' END], lambda x: x IS NOT NULL)) END), ';') AS problems FROM upload_problems p LEFT JOIN run_problems r ON r.sha256 = p.sha256")
def o_q1(spark, sf_dir):
    n = F.col("n")
    u = uploads(spark, sf_dir).withColumns({
        "size": F.when(n % 29 == 0, trust.MAX_BYTES + 1).otherwise(1000), "file_name": F.when(n % 31 == 0, "x").otherwise(F.col("sha256")), "author": F.col("submitter"), "affiliation": F.when(n % 37 == 0, "https://example.org").otherwise("a lab"),
        "week": F.when(n % 41 == 0, "2024-W60").otherwise(F.col("week")), "claim_kind": F.lit("model"), "superseded_attempts": F.when(n % 43 == 0, -1).otherwise(0), "excluded_commits": F.lit(0),
    })
    outcome = F.when(F.col("cents") % 10 == 3, "lost").when(F.col("passed"), "passed").otherwise("timeout")
    commit = F.when(n % 5 != 0, F.lpad(F.col("commit").cast("string"), 40, "0")).otherwise(F.col("commit").cast("string"))
    r = upload_runs(spark, sf_dir).select(
        "sha256", commit.alias("commit"), "setup", (F.col("pos") % 2).alias("repeat"), outcome.alias("outcome"), "passed", F.when(F.col("tokens") % 900 == 0, -1.0).otherwise(1.0).alias("cost_usd"), F.lit(5.0).alias("wall_s"),
        F.array_repeat(F.col("tokens"), 4).alias("tokens"), F.array(F.lit(0.1), F.lit(0.2)).alias("wh"), F.lit("1-5").alias("requests"),
    )
    return trust.validated(u, r).select("sha256", F.array_join("problems", ";").alias("problems"))


# Uploads as files, with what is put in the place of what, so that every rule is broken by some: (divisor of n, remainder for private ones only, text, its
# replacement, rule). Rules of heads stand in their order.
HEAD_BREAKS = [
    (67, True, '"public":false', '"public":0', "public isn't said"), (47, False, '{"usage_upload"', '{"home":"x","usage_upload"', "other fields"),
    (101, False, '"affiliation":"a', '"affiliation":"\u202e', "control characters"), (37, True, '"affiliation":"', '"affiliation":"https://a.example ', "private record with address or commit"),
    (3, True, '"baseline":{', '"baseline":{"command":"x",', "private side's fields"), (149, False, '"repo_id":"', '"repo_id":"Z', "repo_id"), (139, False, '"claude-code', '"claude code', "setup name"),
    (109, False, '"week":"', '"week":"x', "week"), (151, False, '"affiliation":"', '"affiliation":"' + "long " * 20, "affiliation"), (137, False, '"claim_kind":"model"', '"claim_kind":"idea"', "claim or task mode"),
    (113, False, '"superseded_attempts":0', '"superseded_attempts":0.5', "counts"), (53, False, '"versions":{', '"versions":{"shell":"zsh",', "versions"), (103, False, '"answer":"', '"answer":"MAYBE ', "answer"),
    (107, False, '"cost_ratio":', '"cost_ratio":-', "cost ratio"), (71, False, '"energy":{"verdict"', '"energy":{"said"', "energy verdict"),
]
RUN_BREAKS = [
    (61, '"outcome":', '"note":"x","outcome":', "other fields"), (73, '"agent":"claude"', '"agent":7', "agent or model"), (59, '"cost_known":true', '"cost_known":"true"', "bad cost"),
    (89, '"tokens_check":"ok"', '"tokens_check":3', "requests or tokens check"), (97, '"repeat":0', '"repeat":"0"', "bad wall time or repeat"), (43, '"wh":[0.1', '"wh":[0.3', "bad energy"), (41, '"tokens":[', '"tokens":[1.5,', "bad tokens"),
]
OTHER_BREAKS = [(79, '"kind":"verify"', '"kind":"other"'), (83, '"task_mode":"hint"', '"task_mode":"hint')]


def upload_files(spark, sf_dir):
    """(submitter, file_name, sha256, size, text, author) of the uploads, some of them spoilt."""
    n, c = F.col("n"), F.col
    run = lambda commit: F.to_json(F.struct(
        commit.alias("commit"), "setup", (c("pos") % 2).cast("long").alias("repeat"), F.when(c("cents") % 10 == 3, "lost").when(c("passed"), "passed").otherwise("timeout").alias("outcome"), "passed", F.lit("m").alias("model"), F.lit("claude").alias("agent"),
        F.lit(True).alias("cost_known"), F.when(c("tokens") % 900 == 0, -1.0).otherwise(1.0).alias("cost_usd"), F.lit(5.5).alias("wall_s"), F.array_repeat("tokens", 4).alias("tokens"), F.array(F.lit(0.1), F.lit(0.2)).alias("wh"), F.lit("1-5").alias("requests"), F.lit("ok").alias("tokens_check"),
    ))
    told = F.when(n % 5 != 0, run(F.lpad(c("commit").cast("string"), 40, "0"))).otherwise(run(c("commit").cast("long")))
    runs = upload_runs(spark, sf_dir).select("n", F.struct("pos", "cents", "commit", "tokens", "setup", "passed", told.alias("text")).alias("r")).groupBy("n").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"])).alias("runs"))
    rows = uploads(spark, sf_dir).join(runs, "n", "left")
    side = lambda name: F.struct(c(name).alias("name"), F.lit("m").alias("model"))
    head = F.to_json(F.struct(
        F.lit(1).alias("usage_upload"), F.lit("verify").alias("kind"), "week", F.lit("model").alias("claim_kind"), "task_mode", "public", "repo_id", F.struct(F.lit("1").alias("agentmeter"), F.lit("2").alias("prices")).alias("versions"), side("baseline").alias("baseline"),
        side("challenger").alias("challenger"), F.struct("answer", F.lit(0.8).alias("cost_ratio"), F.struct(F.lit("uses less").alias("verdict")).alias("energy")).alias("verdict"), F.lit(0).alias("superseded_attempts"), F.lit(0).alias("excluded_commits"), "rerun_of", F.lit("a lab").alias("affiliation"),
    ))
    text = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"runs":['), F.coalesce("runs", F.lit("")), F.lit("]}"))
    swap = lambda met, old, new: F.when(met, F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")))
    swaps = [swap((n % every == 0) & (~c("public") | F.lit(not private)), old, new) for every, private, old, new, _ in HEAD_BREAKS]
    swaps += [swap(n % every == 0, old, new) for every, old, new, *_ in [*RUN_BREAKS, *OTHER_BREAKS]]
    text = F.aggregate(F.array_compact(F.array(*swaps)), text, lambda t, x: F.replace(t, x["old"], x["new"]))  # only what is spoilt is searched
    rows = rows.withColumn("head", head).select("*", F.explode(F.array(text)).alias("text"))
    return rows.select(
        "submitter", F.when(n % 127 == 0, "x").otherwise(c("sha256")).alias("file_name"), "sha256", F.when(n % 29 == 0, trust.MAX_BYTES + 1).otherwise(F.octet_length("text")).alias("size"), "text", F.when(n % 131 == 0, "zz").otherwise(c("submitter")).alias("author"),
    )


_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_head_sql = [f"CASE WHEN n % {every} = 0{' AND NOT public' * private} THEN {_quoted(rule)} END" for every, private, _, _, rule in HEAD_BREAKS]
_head_sql.insert(9, "CASE WHEN rerun_of IS NOT NULL AND NOT public THEN 'rerun_of' END")
_run_sql = [f"CASE WHEN n % {every} = 0{' AND pos % 2 = 0' * (every == 97)}{' OR tokens % 900 = 0' * (every == 59)} THEN {_quoted(rule)} END" for every, _, _, rule in RUN_BREAKS]
_listed = lambda cases: f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"
PIECES["json_runs"] = f"""SELECT n, rule, rule || ' (runs ' || string_agg(CAST(place AS VARCHAR), ', ' ORDER BY place) || ')' AS text FROM (
    SELECT n, place, unnest({_listed([*_run_sql, "CASE WHEN cents % 10 = 3 THEN 'unknown outcome' END", "CASE WHEN cents % 10 = 3 AND passed THEN 'passed doesn''t match outcome' END"])}) AS rule
    FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY pos, cents, commit, tokens, setup, passed) - 1 AS place FROM upload_runs)) GROUP BY n, rule"""
PIECES["json_sets"] = """SELECT n, max(times) AS most, count(DISTINCT commit) * 2 * count(DISTINCT repeat) - count(*) AS missing
    FROM (SELECT n, commit, setup, pos % 2 AS repeat, count(*) AS times FROM upload_runs GROUP BY ALL) GROUP BY n"""
PIECES["json_uploads"] = f"""SELECT u.*, {_listed(["CASE WHEN u.n % 127 = 0 THEN 'file name isn''t the hash' END", "CASE WHEN u.n % 131 = 0 THEN 'under another submitter' END"])} AS of_file, {_listed(_head_sql).replace("n %", "u.n %")} AS of_head,
    coalesce((SELECT list(text ORDER BY text) FROM json_runs j WHERE j.n = u.n), []) AS of_runs, {_listed(["CASE WHEN most > 1 THEN 'duplicate run' END", "CASE WHEN missing > 0 THEN 'incomplete' END"])} AS of_set, s.n IS NULL AS bare
    FROM uploads u LEFT JOIN json_sets s ON s.n = u.n"""


@query(
    "o_q1_upload_json",
    """SELECT sha256, array_to_string(CASE WHEN n % 29 = 0 THEN ['too large'] WHEN n % 83 = 0 THEN list_concat(of_file, ['not JSON']) WHEN n % 79 = 0 THEN list_concat(of_file, ['not an upload'])
      WHEN bare THEN list_concat(of_file, list_filter(of_head, lambda x: x IN ('public isn''t said', 'other fields')), ['no runs'])
      ELSE list_concat(of_file, of_head, of_runs, of_set) END, ';') AS problems
    FROM json_uploads""",
)
def o_q1_json(spark, sf_dir):
    return upload_ops.validate(upload_files(spark, sf_dir)).select("sha256", F.array_join("problems", ";").alias("problems"))


@query("o_q2_verdict_recheck", """SELECT sha256, array_to_string(list_filter([CASE WHEN same_model THEN 'energy verdict of other models' END, CASE WHEN answer = 'SUPPORTED' AND NOT (c_solved > 0 AND coalesce(b_rate - c_rate <= 0.10, false)) THEN 'supported but solves fewer' END,
    CASE WHEN b_per IS NOT NULL AND c_per IS NOT NULL AND NOT abs(c_per / b_per - claimed) <= greatest(1.0, claimed) * 0.05 THEN 'cost ratio doesn''t match' END, CASE WHEN answer = 'SUPPORTED' AND same_model THEN 'supported without less energy' END,
    CASE WHEN answer = 'SUPPORTED' AND NOT same_model AND NOT coalesce(claimed <= 0.9, false) THEN 'supported without lower cost' END], lambda x: x IS NOT NULL), ';') AS problems FROM (SELECT *, n % 3 = 0 AS same_model, CASE WHEN n % 7 = 0 THEN cost_ratio * 1.5 ELSE cost_ratio END AS claimed FROM uploads)""")
def o_q2(spark, sf_dir):
    u = uploads(spark, sf_dir)
    claims = u.select("sha256", "answer", F.when(F.col("n") % 7 == 0, F.col("cost_ratio") * 1.5).otherwise(F.col("cost_ratio")).alias("cost_ratio"), F.lit(None).cast("string").alias("energy"), (F.col("n") % 3 == 0).alias("same_model"), "c_solved", F.col("b_rate").alias("b_solve_rate"), F.col("c_rate").alias("c_solve_rate"), F.col("b_per").alias("b_cents_per_solved"), F.col("c_per").alias("c_cents_per_solved"))
    return trust.rechecked(claims).select("sha256", F.array_join("problems", ";").alias("problems"))


# A record's runs with what can be wrong in them, attempts that were made again, and commits left out.
PIECES["record_runs"] = """SELECT sha256, commit, CASE WHEN cents % 13 = 5 THEN 'other' ELSE setup END AS setup, pos % 2 AS repeat, CASE WHEN cents % 10 = 3 THEN 'lost' WHEN passed THEN 'passed' ELSE 'tests_failed' END AS outcome, passed,
    CASE WHEN tokens % 900 = 0 THEN -1.0 ELSE 1.0 END AS cost_usd, cents % 7 = 0 AS bare, cents FROM upload_runs"""
PIECES["record_checks"] = """SELECT sha256, count(*) FILTER (outcome = 'lost') AS lost, count(*) FILTER (passed <> (outcome = 'passed')) AS unlike, count(*) FILTER (setup = 'other') AS neither, count(*) FILTER (cost_usd < 0) AS cost,
    count(*) FILTER (passed AND bare) AS bare, count(*) - count(DISTINCT (commit, setup, repeat)) AS twice, count(DISTINCT commit) * 2 * count(DISTINCT repeat) - count(DISTINCT (commit, setup, repeat)) FILTER (setup <> 'other') AS missing,
    count(*) FILTER (cents % 11 = 0) AS redone, count(DISTINCT commit) FILTER (commit % 17 = 0) AS excluded FROM record_runs GROUP BY sha256"""


def record_parts(spark, sf_dir):
    """(runs, attempts made again, commits left out) of the uploads' records."""
    cents = F.col("cents")
    outcome = F.when(cents % 10 == 3, "lost").when(F.col("passed"), "passed").otherwise("tests_failed")
    setup = F.when(cents % 13 == 5, "other").otherwise(F.col("setup"))
    requests = F.when(cents % 7 == 0, F.array().cast("array<array<bigint>>")).otherwise(F.array(F.array_repeat(F.col("tokens"), 4)))
    r = upload_runs(spark, sf_dir).select("sha256", "commit", setup.alias("setup"), (F.col("pos") % 2).alias("repeat"), outcome.alias("outcome"), "passed", F.when(F.col("tokens") % 900 == 0, -1.0).otherwise(1.0).alias("cost_usd"), requests.alias("requests"), F.lit("claude").alias("agent"), "cents")
    return r.drop("cents"), r.where("cents % 11 = 0").select("sha256", "commit", "setup", "repeat", "outcome"), r.where("commit % 17 = 0").select("sha256", "commit").distinct()


@query("o_q3_record_integrity", """SELECT s.sha256, coalesce(array_to_string(list_sort(list_filter([CASE WHEN lost > 0 THEN 'unknown outcome: ' || lost END, CASE WHEN unlike > 0 THEN 'passed doesn''t match outcome: ' || unlike END, CASE WHEN neither > 0 THEN 'setup of neither side: ' || neither END,
    CASE WHEN cost > 0 THEN 'bad cost: ' || cost END, CASE WHEN bare > 0 THEN 'solved without tokens: ' || bare END, CASE WHEN twice > 0 THEN 'duplicate run: ' || twice END], lambda x: x IS NOT NULL)), ';'), '') AS problems,
    coalesce(missing, 0) AS missing, coalesce(redone, 0) AS redone, coalesce(excluded, 0) AS excluded FROM sides s LEFT JOIN record_checks c ON c.sha256 = s.sha256""")
def o_q3(spark, sf_dir):
    found = trust.integrity(sides(spark, sf_dir), *record_parts(spark, sf_dir))
    return found.withColumn("problems", F.array_join("problems", ";"))


@query("o_q6_upload_view", """SELECT sha256, pos, dense_rank() OVER (PARTITION BY sha256 ORDER BY first_pos) - 1 AS commit_no, CASE WHEN setup = 'custom' THEN 'custom' ELSE setup END AS setup, CAST(round_even(tokens / pow(10, floor(log10(tokens)) - 1), 0) * pow(10, floor(log10(tokens)) - 1) AS BIGINT) AS tokens,
    CAST(round_even(tokens / 10.0, 0) * 10 AS BIGINT) AS wall_s, round_even(cents / 128.0::DOUBLE, 2) AS cost_usd, CASE WHEN pos <= 5 THEN '1-5' ELSE '6-20' END AS requests FROM (SELECT *, min(pos) OVER (PARTITION BY sha256, commit) AS first_pos FROM upload_runs)""")
def o_q6(spark, sf_dir):
    r = upload_runs(spark, sf_dir).withColumns({"agent": F.lit("claude"), "wall_s": F.col("tokens").cast("double"), "cost_usd": F.col("cents") / 128.0, "requests": F.col("pos")})
    return trust.upload_view(r)


@query("o_q7_repo_owners", "SELECT repo_id, arg_min(submitter, {'w': week, 's': sha256}) AS owner FROM uploads GROUP BY repo_id")
def o_q7(spark, sf_dir):
    return trust.owners(uploads(spark, sf_dir))


PIECES["upload_keys"] = "SELECT u.*, array_to_string(list_sort(commits), ',') AS key FROM uploads u JOIN (SELECT n, list(DISTINCT commit) AS commits FROM upload_runs GROUP BY n) c ON c.n = u.n"
PIECES["rerun_pairs"] = """SELECT a.rerun_of AS target, a.sha256, a.answer FROM uploads a JOIN uploads t ON t.sha256 = a.rerun_of AND t.baseline = a.baseline AND t.challenger = a.challenger AND t.task_mode = a.task_mode
    LEFT JOIN upload_keys x ON x.n = a.n LEFT JOIN upload_keys y ON y.n = t.n WHERE a.public AND t.public AND a.submitter <> t.submitter AND x.key IS NOT DISTINCT FROM y.key"""


def keyed(spark, sf_dir):
    return trust.with_key(uploads(spark, sf_dir, commits=trust.commit_set("commit")))


@query("o_j19_reruns", "SELECT target, sha256, answer FROM rerun_pairs")
def o_j19(spark, sf_dir):
    return trust.reruns(keyed(spark, sf_dir))


@query("o_j19_rerun_keys", "SELECT sha256, md5(key) AS key FROM upload_keys")
def o_j19k(spark, sf_dir):
    commits = F.array_join(F.from_json(F.get_json_object("key", "$.commits"), "array<bigint>"), ",")
    return keyed(spark, sf_dir).where(commits.isNotNull()).select("sha256", F.md5(commits).alias("key"))


PIECES["tiered"] = "SELECT u.*, CASE WHEN rerun_of IS NOT NULL THEN 'rerun' WHEN against THEN 'disputed' WHEN against IS NOT NULL THEN 'reproduced' ELSE 'self-reported' END AS tier FROM uploads u LEFT JOIN (SELECT target, bool_or(p.answer <> t.answer) AS against FROM rerun_pairs p JOIN uploads t ON t.sha256 = p.target GROUP BY target) x ON x.target = u.sha256"


def tiered(spark, sf_dir):
    return trust.tiers(keyed(spark, sf_dir))


@query("o_a28_trust_tiers", "SELECT sha256, tier FROM tiered")
def o_a28(spark, sf_dir):
    return tiered(spark, sf_dir).select("sha256", "tier")


@query("o_w9_newest_record", "SELECT sha256 FROM (SELECT *, row_number() OVER (PARTITION BY submitter, repo_id ORDER BY week DESC, sha256) AS k FROM uploads) WHERE k = 1")
def o_w9(spark, sf_dir):
    return trust.newest(uploads(spark, sf_dir), []).select("sha256")


@query("o_w10_repos_per_account", "SELECT sha256 FROM (SELECT *, row_number() OVER (PARTITION BY challenger, submitter ORDER BY week DESC, repo_id, sha256) AS k FROM uploads) WHERE k <= 3")
def o_w10(spark, sf_dir):
    return trust.at_most(uploads(spark, sf_dir), ["challenger"]).select("sha256")


PIECES["board"] = """SELECT *, row_number() OVER (PARTITION BY tier, baseline, challenger, submitter ORDER BY week DESC, repo_id, sha256) AS place FROM (SELECT *, row_number() OVER (PARTITION BY tier, baseline, challenger, submitter, repo_id ORDER BY week DESC, sha256) AS k FROM tiered
    WHERE tier IN ('reproduced', 'self-reported') AND challenger <> 'custom' AND NOT (challenger = 'claude-code@m1' AND submitter = 's1' AND tier <> 'reproduced')) WHERE k = 1"""


@query("o_a27_scoreboard", """SELECT g.*, submitters, repos >= 5 AND submitters >= 3 AND most <= runs * 0.5 AS shown FROM (SELECT tier, baseline, challenger, count(*) AS repos, count(*) FILTER (answer = 'SUPPORTED') AS supported, count(*) FILTER (answer = 'NOT SUPPORTED') AS not_supported, count(*) FILTER (answer = 'NOT PROVEN') AS not_proven,
    round(median(cost_ratio), 6) AS median_cost_ratio, round(median(solve_diff), 6) AS median_solve_diff FROM board WHERE place <= 3 GROUP BY ALL) g JOIN (SELECT tier AS t, challenger AS c, count(*) AS submitters, max(runs) AS most, sum(runs) AS runs FROM (SELECT tier, challenger, submitter, sum(n_runs) AS runs FROM board WHERE place <= 3 GROUP BY ALL) GROUP BY ALL) s ON s.t = g.tier AND s.c = g.challenger""".replace("g.*, submitters", "tier, baseline, challenger, repos, supported, not_supported, not_proven, median_cost_ratio, median_solve_diff, submitters"))
def o_a27(spark, sf_dir):
    vendors = spark.createDataFrame([("claude-code@m1", "s1")], "challenger string, submitter string")
    return rounded(trust.scoreboard(tiered(spark, sf_dir), vendors), 6, "median_cost_ratio", "median_solve_diff")


@query("o_a31_evidence_ranking", "SELECT kind, model, week, id, row_number() OVER (PARTITION BY model ORDER BY week DESC, kind, id) AS rank FROM (SELECT 'verified' AS kind, challenger AS model, week, sha256 AS id FROM uploads WHERE answer = 'SUPPORTED' AND challenger <> 'custom' UNION ALL SELECT 'picked', challenger, week, sha256 FROM uploads WHERE n % 19 = 0)")
def o_a31(spark, sf_dir):
    u = uploads(spark, sf_dir).select(F.col("challenger").alias("model"), "week", F.col("sha256").alias("id"), "answer", (F.col("challenger") != "custom").alias("same_vendor"), (F.col("n") % 19 == 0).alias("picked"))
    return trust.evidence(u, u)


_HIDE = "CASE WHEN public THEN CAST(commit AS VARCHAR) ELSE substr(sha256(sha256('salt:' || s.sha256) || ':' || commit), 1, 16) END"
PIECES["hidden_runs"] = f"SELECT s.sha256, r.*, {_HIDE} AS shown FROM sides s JOIN (SELECT sha256 AS h, * EXCLUDE (sha256) FROM record_runs) r ON r.h = s.sha256"


@query("o_q5_record_builder", """SELECT s.sha256, s.public, coalesce(runs, 0) AS runs, md5(coalesce(text, '')) AS digest, coalesce(redone, 0) AS superseded, coalesce(gone, '') AS excluded FROM sides s LEFT JOIN (
    SELECT sha256, count(*) AS runs, string_agg(concat_ws(':', shown, setup, repeat, outcome), ',' ORDER BY concat_ws(':', shown, setup, repeat, outcome)) AS text, count(*) FILTER (cents % 11 = 0) AS redone,
    array_to_string(list_sort(list(DISTINCT shown) FILTER (commit % 17 = 0)), ',') AS gone FROM hidden_runs GROUP BY sha256) r ON r.sha256 = s.sha256""")
def o_q5(spark, sf_dir):
    built = trust.record(sides(spark, sf_dir).select("sha256", "public"), *record_parts(spark, sf_dir), "salt")
    run = F.transform("runs", lambda r: F.concat_ws(":", r["commit"], r["setup"], r["repeat"].cast("string"), r["outcome"]))
    gone = F.array_join(F.array_sort(F.transform("excluded_commits", lambda r: r["commit"])), ",")
    return built.select("sha256", "public", F.size("runs").cast("long").alias("runs"), F.md5(F.array_join(F.array_sort(run), ",")).alias("digest"), F.size("superseded_attempts").cast("long").alias("superseded"), gone.alias("excluded"))


