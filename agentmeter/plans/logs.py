"""Queries that read logs: the driver's tables written as log rows, then parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.functions import text as tx
from agentmeter.operators import requests as rq
from agentmeter.plans.registry import PIECES, query
from agentmeter.sources import other_logs, session_logs

_KEY = b"a key from the configuration"
# What becomes of a request's log rows, by id: cut lines, synthetic models, negative tokens.
PIECES["log_kinds"] = "SELECT *, CASE WHEN request_id % 50 = 0 THEN 'corrupt' WHEN request_id % 50 = 1 THEN 'synthetic' WHEN request_id % 50 = 2 THEN 'bad_shape' ELSE 'usage' END AS kind FROM raw_rows"
_COMMANDS = """CASE {k} % 6 WHEN 0 THEN 'git log | grep commit' WHEN 1 THEN concat('cd /repos/r', {u} % 8, ' && git commit -m x') WHEN 2 THEN concat('git -C /repos/r', {u} % 8, ' commit -am y > out', {k}, '.txt') WHEN 3 THEN concat('sed -i s/a/b/ f', {k}, '.py && echo done >> log.txt')
    WHEN 4 THEN concat('cp a', {k}, ' b', {k}, '; rm -f c') ELSE 'ls -la 2>&1 > /dev/null' END"""


def log_lines(spark, sf_dir):
    """One JSON line a raw row, with a shell call and its result in the content.

    The line is a generated column, as one read from a file would be there: else Catalyst makes its JSON again for each mention in a filter.
    """
    raw = fx.raw_request_rows(spark, sf_dir).withColumn("command", F.expr(_COMMANDS.format(k="k", u="session_id")))
    bad, synthetic = F.col("request_id") % 50 == 2, F.col("request_id") % 50 == 1
    text = lambda c: F.col(c).cast("string")
    none = lambda name: F.lit(None).cast("string").alias(name)
    use = F.struct(
        F.lit("tool_use").alias("type"), F.concat(F.lit("t"), text("request_id")).alias("id"), F.when(F.col("k") % 7 == 0, "Edit").otherwise("Bash").alias("name"), none("tool_use_id"),
        F.struct(F.when(F.col("k") % 7 != 0, F.col("command")).alias("command"), F.when(F.col("k") % 7 == 0, F.concat(F.lit("f"), text("k"))).alias("file_path"), none("notebook_path")).alias("input"),
    )
    usage = F.struct(
        F.when(bad, -1).otherwise(F.col("fresh_in")).alias("input_tokens"), F.col("cache_write").alias("cache_creation_input_tokens"), F.col("cache_read").alias("cache_read_input_tokens"),
        (F.col("output") - F.col("output") % 3).alias("output_tokens"), F.struct(F.col("cache_write_1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"), F.struct((F.col("output") % 3).alias("thinking_tokens")).alias("output_tokens_details"),
    )
    message = F.struct(F.concat(F.lit("m"), text("request_id")).alias("id"), F.when(synthetic, session_logs.SYNTHETIC).otherwise(F.col("model")).alias("model"), F.lit("assistant").alias("role"), F.array(use).alias("content"), usage.alias("usage"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    row = F.to_json(F.struct(F.lit("assistant").alias("type"), text("session_id").alias("sessionId"), "cwd", stamp.alias("timestamp"), F.col("is_sidechain").alias("isSidechain"), F.concat(F.lit("2."), (F.col("k") % 3).cast("string")).alias("version"), F.when(F.col("k") % 4 != 0, text("request_id")).alias("requestId"), message.alias("message")))
    cut = F.when(F.col("request_id") % 50 == 0, F.substring(row, 1, 200)).otherwise(row)
    call = raw.select(F.explode(F.array(cut)).alias("value"), "file_path")
    block = F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), text("request_id")).alias("tool_use_id")))
    late = F.date_format(F.col("ts") + F.expr("INTERVAL 3 SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    results = raw.where("copy = 1 AND k % 5 <> 0").select(F.to_json(F.struct(F.lit("user").alias("type"), text("session_id").alias("sessionId"), "cwd", late.alias("timestamp"), F.struct(F.lit("user").alias("role"), block.alias("content")).alias("message"))).alias("line"), "file_path")
    results = results.select(F.explode(F.array("line")).alias("value"), "file_path")
    return call.unionByName(results)


@query("o_s1_session_logs", "SELECT CASE WHEN k % 4 = 0 THEN session_id || ':m' || request_id ELSE CAST(request_id AS VARCHAR) END AS request_id, CAST(session_id AS VARCHAR) AS session_id, model, ts, fresh_in, cache_write, cache_read, max(output) AS output, cache_write_1h, cwd, is_sidechain FROM log_kinds WHERE kind = 'usage' GROUP BY ALL")
def o_s1(spark, sf_dir):
    rows = session_logs.parsed(log_lines(spark, sf_dir))
    return rq.dedupe(session_logs.request_rows(rows)).drop("file_path")


@query("o_a7_parse_stats", "SELECT kind, count(*) AS n FROM (SELECT kind FROM log_kinds UNION ALL SELECT 'other' FROM requests WHERE k % 5 <> 0) GROUP BY kind")
def o_a7(spark, sf_dir):
    return session_logs.parse_stats(session_logs.parsed(log_lines(spark, sf_dir)))


@query("o_a7_coverage", "SELECT count(*) FILTER (kind = 'usage') AS kept, count(*) FILTER (kind IN ('bad_shape', 'corrupt')) AS skipped, count(*) FILTER (kind = 'usage') / count(*) FILTER (kind <> 'synthetic') AS coverage FROM log_kinds")
def o_a7c(spark, sf_dir):
    return session_logs.coverage(session_logs.parsed(log_lines(spark, sf_dir)))


@query("o_a7_versions", "SELECT '2.' || (k % 3) AS version, count(*) AS n FROM log_kinds WHERE kind <> 'corrupt' GROUP BY 1")
def o_a7v(spark, sf_dir):
    return session_logs.versions(session_logs.parsed(log_lines(spark, sf_dir)).where("kind <> 'corrupt'"))


@query("o_j20_call_intervals", "SELECT CAST(session_id AS VARCHAR) AS session_id, '/repos/r' || (session_id % 8) AS cwd, ts AS start_ts, CASE WHEN k % 5 <> 0 THEN ts + INTERVAL 3 SECOND END AS end_ts FROM requests WHERE request_id % 50 <> 0 AND k % 7 <> 0 AND k % 6 IN (1, 2)")
def o_j20(spark, sf_dir):
    return session_logs.commit_calls(session_logs.blocks(session_logs.parsed(log_lines(spark, sf_dir))))


PIECES["log_touched"] = """SELECT DISTINCT CAST(session_id AS VARCHAR) AS session_id, cwd, unnest(CASE WHEN k % 7 = 0 THEN ['f' || k] WHEN k % 6 = 2 THEN ['out' || k || '.txt'] WHEN k % 6 = 3 THEN ['f' || k || '.py', 'log.txt'] WHEN k % 6 = 4 THEN ['a' || k, 'b' || k, 'c'] ELSE [] END) AS path
    FROM requests WHERE request_id % 50 <> 0"""


@query("o_p9_touched_files", "SELECT session_id, cwd, path FROM log_touched")
def o_p9(spark, sf_dir):
    return session_logs.touched(session_logs.blocks(session_logs.parsed(log_lines(spark, sf_dir))))


@query("o_p8_commit_commands", "SELECT request_id, k % 6 IN (1, 2) AS commits, CASE WHEN k % 6 IN (1, 2) THEN '/repos/r' || (session_id % 8) END AS dir FROM requests")
def o_p8(spark, sf_dir):
    r = fx.requests(spark, sf_dir).withColumn("command", F.expr(_COMMANDS.format(k="k", u="session_id")))
    return r.select("request_id", tx.is_commit(F.col("command")).alias("commits"), tx.commit_dir(F.col("command"), F.col("cwd")).alias("dir"))


@query("o_p9_redirects", "SELECT request_id, CASE k % 6 WHEN 2 THEN 'out' || k || '.txt' WHEN 3 THEN 'log.txt' ELSE '' END AS targets FROM requests")
def o_p9r(spark, sf_dir):
    r = fx.requests(spark, sf_dir).withColumn("command", F.expr(_COMMANDS.format(k="k", u="session_id")))
    return r.select("request_id", F.array_join(tx.redirect_targets(F.col("command")), ",").alias("targets"))


@query("o_s2_rollout_logs", """SELECT 'rollout:' || user_id || ':' || row_number() OVER (PARTITION BY user_id ORDER BY ts) AS request_id, 'rollout:' || user_id AS session_id, coalesce(model, 'unknown') AS model, ts, greatest(0, 100 * k - 60 * k - k) AS fresh_in, k AS cache_write, 60 * k AS cache_read, 5 * k + 2 AS output, '/w/' || user_id AS cwd
    FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN 'm' || (k % 3) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM ev) WHERE event_type = 'view'""")
def o_s2(spark, sf_dir):
    return other_logs.rollout_usage(other_logs.rollout_rows(rollout_lines(spark, sf_dir)))


def rollout_lines(spark, sf_dir):
    e = fx._events(spark, sf_dir)
    user = F.col("user_id").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    row = lambda kind, at_, **payload: F.to_json(F.struct(at_.alias("timestamp"), F.lit(kind).alias("type"), F.struct(*[v.alias(k) for k, v in payload.items()]).alias("payload")))
    meta = e.groupBy("user_id").agg(F.min("ts").alias("ts")).select(row("session_meta", F.date_format(F.col("ts") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), session_id=user, cwd=F.concat(F.lit("/w/"), user)).alias("value"), F.concat(F.lit("u"), user).alias("file_path"))
    k = F.col("k")
    usage = F.struct((k * 100).alias("input_tokens"), (k * 60).alias("cached_input_tokens"), k.alias("cache_write_input_tokens"), (k * 5).alias("output_tokens"), F.lit(2).alias("reasoning_output_tokens"))
    counted = row("event_msg", stamp, type=F.lit("token_count"), info=F.struct(usage.alias("last_token_usage")))
    turn = row("turn_context", stamp, model=F.concat(F.lit("m"), (k % 3).cast("string")))
    call = row("response_item", stamp, type=F.lit("function_call"), call_id=F.col("event_id").cast("string"), arguments=F.to_json(F.struct(F.array(F.lit("git"), F.lit("commit"), F.lit("-m"), F.lit("x")).alias("command"))))
    output = row("response_item", F.date_format(F.col("ts") + F.expr("INTERVAL 2 SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), type=F.lit("function_call_output"), call_id=F.col("event_id").cast("string"))
    kind = F.col("event_type")
    value = F.when(kind == "view", F.array(counted)).when(kind == "click", F.array(turn)).when(kind == "purchase", F.array(call, output))
    return meta.union(e.where(kind.isin("view", "click", "purchase")).select(F.explode(value).alias("value"), F.concat(F.lit("u"), user).alias("file_path")))


@query("o_p11_rollout_calls", "SELECT 'rollout:' || user_id AS session_id, '/w/' || user_id AS cwd, ts AS start_ts, ts + INTERVAL 2 SECOND AS end_ts FROM ev WHERE event_type = 'purchase'")
def o_p11(spark, sf_dir):
    return other_logs.rollout_calls(other_logs.rollout_rows(rollout_lines(spark, sf_dir)))


PIECES["export_rows"] = "SELECT o_orderkey, 'u' || (o_custkey % 9) AS person, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'claude-4.6-sonnet-medium-thinking' WHEN 1 THEN 'claude-4-opus' WHEN 2 THEN 'claude-x.5' ELSE 'other-1.0' END AS model, o_orderkey AS tokens FROM orders"


@query("o_s3_usage_export", """SELECT DISTINCT 'export:' || person AS session_id, CASE o_orderkey % 4 WHEN 0 THEN 'claude-sonnet-4-6' WHEN 1 THEN 'claude-opus-4' WHEN 2 THEN 'claude-x-5' ELSE 'other-1.0' END AS model, o_orderdate AS ts,
    CASE WHEN tokens % 13 = 0 THEN 0 ELSE tokens END AS fresh_in, CAST(27 AS BIGINT) AS cache_write, tokens * 3 AS cache_read, tokens % 1000 AS output FROM export_rows WHERE tokens % 17 <> 0 AND tokens % 19 <> 0""")
def o_s3(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    model = F.when(k % 4 == 0, "claude-4.6-sonnet-medium-thinking").when(k % 4 == 1, "claude-4-opus").when(k % 4 == 2, " claude-x.5").otherwise("other-1.0")
    export = o.select(
        F.when(k % 17 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("Date"), F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")).alias("User"), model.alias("Model"),
        F.when(k % 19 == 0, "-5").otherwise("27").alias("Input (w/ Cache Write)"), F.when(k % 13 == 0, "n/a").otherwise(F.format_number(k, 0)).alias("Input (w/o Cache Write)"), (k * 3).cast("string").alias("Cache Read"), (k % 1000).cast("string").alias("Output Tokens"),
    )
    return other_logs.usage_rows(export.union(export))


def patch_records(spark, sf_dir):
    lines = fx.commit_lines(spark, sf_dir)
    body = lines.groupBy("sha", "path").agg(F.concat_ws("\n", F.lit("--- a/x"), F.concat(F.lit("+++ b/"), "path"), F.array_join(F.sort_array(F.collect_list(F.concat("side", "line"))), "\n")).alias("body"), F.count_if(F.col("side") == "+").alias("a"), F.count_if(F.col("side") == "-").alias("d"))
    head = F.concat_ws("\x1f", F.col("sha").cast("string"), F.lit("1700000000"), F.lit("me@example.org"), F.concat(F.lit("change "), F.col("sha").cast("string")))
    stat = F.concat_ws("\t", F.col("a").cast("string"), F.col("d").cast("string"), "path")
    return body.select(F.concat_ws("\n", head, stat, "body").alias("value"))


@query("o_s4_patch_log_files", "SELECT CAST(sha AS VARCHAR) AS sha, path, count(*) FILTER (side = '+') AS added, count(*) FILTER (side = '-') AS deleted FROM commit_lines GROUP BY sha, path")
def o_s4f(spark, sf_dir):
    return other_logs.patch_lines(patch_records(spark, sf_dir))[1]


@query("o_s4_patch_log_lines", "SELECT DISTINCT CAST(sha AS VARCHAR) AS sha, path, side, line FROM commit_lines")
def o_s4l(spark, sf_dir):
    return other_logs.patch_lines(patch_records(spark, sf_dir))[2]


@query("o_s11_merged_sources", "SELECT 'session' AS source, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output FROM requests UNION ALL SELECT 'rollout', count(*), CAST(sum(5 * k + 2) AS BIGINT) FROM ev WHERE event_type = 'view'")
def o_s11(spark, sf_dir):
    a = fx.requests(spark, sf_dir).withColumn("request_id", F.col("request_id").cast("string")).withColumn("session_id", F.col("session_id").cast("string")).withColumn("source", F.lit("session"))
    b = other_logs.rollout_usage(other_logs.rollout_rows(rollout_lines(spark, sf_dir))).withColumn("source", F.lit("rollout"))
    return session_logs.merged(a, b).groupBy("source").agg(F.count("*").alias("requests"), F.sum("output").alias("output"))


@query("o_s5_run_results", "SELECT repo, commit, setup, repeat, passed, cents FROM runs WHERE commit % 10 <> 7")
def o_s5(spark, sf_dir):
    """Runs as JSON lines with exclusion lines between them, read back."""
    r = fx.runs(spark, sf_dir)
    line = F.to_json(F.struct(F.col("repo").cast("string").alias("repo"), F.col("commit").cast("string").alias("commit"), "setup", "repeat", "passed", F.col("cents").alias("cost_usd")))
    gone = r.where("commit % 10 = 7").select("commit").distinct().select(F.to_json(F.struct(F.col("commit").cast("string").alias("excluded_commit"), F.lit("listed").alias("reason"))).alias("value"))
    rows = r.select(line.alias("value")).union(gone).select(F.from_json("value", other_logs.RUN).alias("r")).select("r.*")
    runs, excluded = rows.where("excluded_commit IS NULL").drop("excluded_commit"), rows.where("excluded_commit IS NOT NULL").select(F.col("excluded_commit").alias("commit"))
    return runs.join(excluded, "commit", "left_anti").select(F.col("repo").cast("long"), F.col("commit").cast("long"), "setup", "repeat", "passed", F.col("cost_usd").cast("long").alias("cents"))


@query("o_p12_normal_path", "SELECT DISTINCT cwd, k % 10 AS n, CASE WHEN k % 10 < 5 THEN 'src/f' || (k % 10) END AS relative FROM requests")
def o_p12(spark, sf_dir):
    r = fx.requests(spark, sf_dir).select("cwd", (F.col("k") % 10).alias("n")).distinct()
    path = F.concat("cwd", F.when(F.col("n") < 5, "/./lib/../src//f").otherwise("/../../outside/f"), F.col("n").cast("string"))
    return r.select("cwd", "n", tx.repo_relative(path, F.col("cwd")).alias("relative"))


PIECES["dirs"] = "SELECT DISTINCT cwd || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '/a/b' ELSE '/sub/c' END AS dir FROM requests"


@query("o_j1_dir_to_repo", "SELECT dir, (SELECT repo FROM (SELECT DISTINCT cwd AS repo FROM requests UNION SELECT DISTINCT cwd || '/sub' FROM requests) WHERE dir = repo OR starts_with(dir, repo || '/') ORDER BY length(repo) DESC LIMIT 1) AS repo FROM dirs")
def o_j1(spark, sf_dir):
    from agentmeter.operators.paths import nearest_repo

    r = fx.requests(spark, sf_dir)
    dirs = r.select(F.concat("cwd", F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "/a/b").otherwise("/sub/c")).alias("dir"))
    repos = r.select("cwd").distinct().select(F.col("cwd").alias("repo"))
    return nearest_repo(dirs, repos.union(repos.select(F.concat("repo", F.lit("/sub")))))


PIECES["talk"] = "SELECT *, text || CASE conv_id % 3 WHEN 0 THEN chr(10) || '**STATUS: DONE**' WHEN 1 THEN chr(10) || 'status: not done' ELSE '' END || CASE conv_id % 4 WHEN 0 THEN chr(10) || '> Outcome: **completed**' WHEN 1 THEN chr(10) || 'Outcome: blocked' ELSE '' END AS said FROM conversations"


def talk(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    end = F.when(F.col("conv_id") % 3 == 0, "\n**STATUS: DONE**").when(F.col("conv_id") % 3 == 1, "\nstatus: not done").otherwise("")
    outcome = F.when(F.col("conv_id") % 4 == 0, "\n> Outcome: **completed**").when(F.col("conv_id") % 4 == 1, "\nOutcome: blocked").otherwise("")
    return c.withColumn("said", F.concat("text", end, outcome))


@query("o_p23_claims", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'not_done' ELSE 'none' END AS claim, CASE conv_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'blocked' ELSE 'none' END AS outcome FROM talk WHERE said IS NOT NULL")
def o_p23(spark, sf_dir):
    return talk(spark, sf_dir).where("said IS NOT NULL").select("conv_id", "turn", tx.claim(F.col("said")).alias("claim"), tx.worker_outcome(F.col("said")).alias("outcome"))


@query("o_p27_last_message", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id")
def o_p27(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    return c.where("role = 'assistant' AND text IS NOT NULL").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("o_p34_typed_prompts", "SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS prompt FROM conversations WHERE role = 'user' AND length(trim(text, ' ')) > 0 AND NOT starts_with(ltrim(text, ' '), '<') AND NOT starts_with(ltrim(text, ' '), '[')")
def o_p34(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), "role", "text", F.lit(False).alias("is_sidechain"))
    return session_logs.typed_prompts(c).select(F.col("session_id").alias("conv_id"), F.col("ts").alias("turn"), "prompt")


_SPACE = "[ \\t\\n\\x0b\\f\\r]"


@query("o_p21_task_measures", f"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, ' ')) END AS words
    FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g'), ' ') AS t FROM documents)""")
def o_p21(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).cast("long").alias("words"))


@query("o_p22_trailers", f"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS body FROM conversations")
def o_p22(spark, sf_dir):
    signed = F.concat("text", F.lit("\nCo-Authored-By: someone <s@example.org>\nsigned-off-by: x"))
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.without_trailers(signed).alias("body"))


@query("o_p25_account_errors", "SELECT request_id, k % 4 = 0 OR k % 5 = 0 AS account, k % 3 = 0 AS other FROM requests")
def o_p25(spark, sf_dir):
    r = fx.requests(spark, sf_dir)
    message = F.concat(F.when(F.col("k") % 4 == 0, "Your Credit Balance is too low. ").otherwise("went on. "), F.when(F.col("k") % 3 == 0, "error: Quota exceeded").otherwise(""))
    status = F.when(F.col("k") % 5 == 0, 401).otherwise(500)
    return r.select("request_id", tx.is_account_error(message, status).alias("account"), tx.is_account_error(message, status, other=True).alias("other"))


@query("o_p26_token_check", "SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'unverified' WHEN session_id % 5 = 1 THEN 'mismatch' ELSE 'ok' END AS verdict FROM (SELECT session_id, sum(output) AS n FROM requests GROUP BY session_id)")
def o_p26(spark, sf_dir):
    r = fx.requests(spark, sf_dir).groupBy("session_id").agg(F.sum("output").alias("ours"))
    theirs = F.when(F.col("session_id") % 5 == 1, F.col("ours") * 2).when(F.col("session_id") % 5 != 0, F.col("ours") + 10)
    return r.select("session_id", tx.token_check(F.col("ours"), theirs, F.when(F.col("session_id") % 5 > 1, F.lit(10))).alias("verdict"))


@query("o_p28_anonymised", "SELECT request_id, CAST(CASE WHEN n <= 0 THEN 0 ELSE round_even(n / pow(10, floor(log10(n)) - 1), 0) * pow(10, floor(log10(n)) - 1) END AS BIGINT) AS tokens, CASE WHEN k <= 5 THEN '1-5' WHEN k <= 20 THEN '6-20' WHEN k <= 50 THEN '21-50' ELSE '51+' END AS bucket, '5.' || (k % 30) AS version, strftime(ts, '%G-W%V') AS week FROM (SELECT *, fresh_in + cache_write AS n FROM requests)")
def o_p28(spark, sf_dir):
    from agentmeter.operators.rollup import iso_week

    version = F.concat(F.lit("v5."), (F.col("k") % 30).cast("string"), F.lit(".17-beta"))
    return fx.requests(spark, sf_dir).select("request_id", tx.two_figures(F.col("fresh_in") + F.col("cache_write")).alias("tokens"), tx.count_bucket(F.col("k")).alias("bucket"), tx.major_minor(version).alias("version"), iso_week(F.col("ts")).alias("week"))


_PAD = lambda x: "".join(f"{b ^ x:02x}" for b in _KEY.ljust(64, b"\0"))


@query("o_p29_pseudonyms", f"SELECT DISTINCT session_id, sha256(unhex('{_PAD(0x5C)}' || sha256(unhex('{_PAD(0x36)}' || hex(CAST(session_id AS VARCHAR)))))) AS pseudonym FROM requests")
def o_p29(spark, sf_dir):
    return fx.requests(spark, sf_dir).select("session_id").distinct().select("session_id", tx.hmac_sha256(_KEY, F.col("session_id").cast("string")).alias("pseudonym"))


@query("o_p30_public_names", "SELECT DISTINCT model, CASE k % 3 WHEN 0 THEN 'claude-code@' || model WHEN 1 THEN 'cmd' ELSE 'custom' END AS name FROM requests")
def o_p30(spark, sf_dir):
    r = fx.requests(spark, sf_dir)
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("claude-code@"), "model")).otherwise(F.concat(F.lit("my tool "), "model"))
    return r.select("model", tx.public_name(name, F.when(F.col("k") % 3 == 1, "cmd").otherwise("claude")).alias("name")).distinct()


@query("o_p31_claim_kind", "SELECT request_id, CASE WHEN k % 2 = 0 THEN 'agent' WHEN k % 3 = 0 THEN 'model' ELSE 'setup' END AS kind FROM requests")
def o_p31(spark, sf_dir):
    k = F.col("k")
    return fx.requests(spark, sf_dir).select("request_id", tx.claim_kind(F.lit("a"), F.when(k % 2 == 0, "b").otherwise("a"), F.when(k % 3 == 0, F.col("model")), F.lit(None).cast("string")).alias("kind"))


@query("o_p33_public_urls", "SELECT page_id, 'https://git.example.org/team/p' || page_id AS repo FROM pages")
def o_p33(spark, sf_dir):
    p = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("git@git.example.org:team/p"), p, F.lit(".git"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://user:secret@git.example.org/team/p"), p)).otherwise(F.concat(F.lit("ssh://git@git.example.org/team/p"), p, F.lit(".git")))
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.public_url(url).alias("repo"))


@query("o_p20_count_labels", "SELECT order_key, line_no, CASE WHEN x < 1 THEN '<1' WHEN x < 2 THEN regexp_replace(format('{:.1f}', round_even(x, 1)), '\\.0$', '') WHEN x < 100 THEN format('{:,}', CAST(round_even(x, 0) AS BIGINT)) WHEN x < 1000 THEN format('{:,}', CAST(round_even(x / 10, 0) * 10 AS BIGINT)) ELSE format('{:,}', CAST(round_even(x / 100, 0) * 100 AS BIGINT)) END AS label FROM (SELECT order_key, line_no, cents / 4096 AS x FROM runs)")
def o_p20l(spark, sf_dir):
    return fx.runs(spark, sf_dir).select("order_key", "line_no", rq.count_label(F.col("cents") / 4096).alias("label"))


@query("o_j21_label_candidates", """SELECT sha, session_id, rank FROM (SELECT c.sha, s.session_id, row_number() OVER (PARTITION BY c.sha ORDER BY abs(epoch_us(c.ts) - epoch_us(s.near)), s.session_id) AS rank FROM commits c CROSS JOIN LATERAL (
    SELECT r.session_id, max(r.ts) AS near FROM requests r WHERE r.session_id % 8 = c.repo AND r.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 5 MINUTE GROUP BY r.session_id) s) WHERE rank <= 5""")
def o_j21(spark, sf_dir):
    from agentmeter.operators.labels import candidates

    r = fx.requests(spark, sf_dir).withColumn("repo", F.col("session_id") % 8)
    return candidates(r, fx.commits(spark, sf_dir)).select("sha", "session_id", "rank")


@query("o_a29_attribution_eval", """SELECT tier, count(*) AS claimed, count(*) FILTER (truth = heaviest) AS correct, count(*) FILTER (truth IS NULL) AS false_claims, count(*) FILTER (truth = heaviest) / count(*) FILTER (truth IS NOT NULL) AS precision FROM (
    SELECT n.tier, h.heaviest, CASE WHEN n.sha % 9 = 0 THEN NULL WHEN n.sha % 9 = 1 THEN -1 ELSE c.author END AS truth FROM named n JOIN commits c ON c.repo = n.repo AND c.sha = n.sha
    JOIN (SELECT repo, sha, arg_max(session_id, {'w': w, 's': -session_id}) AS heaviest FROM (SELECT repo, sha, session_id, sum(weight) AS w FROM all_rows GROUP BY ALL) GROUP BY repo, sha) h ON h.repo = n.repo AND h.sha = n.sha) GROUP BY tier""")
def o_a29(spark, sf_dir):
    from agentmeter.operators.labels import evaluation
    from agentmeter.plans.attribution import World

    w = World(spark, sf_dir)
    truth = w.commits.select("repo", "sha", F.when(F.col("sha") % 9 == 0, None).when(F.col("sha") % 9 == 1, -1).otherwise(F.col("author")).alias("truth"))
    return evaluation(w.rows, w.named, truth)


@query("o_t2_sample", "SELECT sha FROM commits ORDER BY md5('7:' || sha), sha LIMIT 50")
def o_t2(spark, sf_dir):
    from agentmeter.operators.labels import sample

    return sample(fx.commits(spark, sf_dir), 7, 50).select("sha")


@query("o_t1_ordered_requests", "SELECT request_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS place FROM requests")
def o_t1(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "request_id")).cast("long")
    return fx.requests(spark, sf_dir).select("request_id", "ts", place.alias("place")).orderBy("ts", "request_id")


@query("o_s12_published_runs", "SELECT 'https://git.example.org/r' || repo AS repo, count(*) AS runs FROM runs GROUP BY repo")
def o_s12(spark, sf_dir):
    from agentmeter.operators.trust import published

    runs = fx.runs(spark, sf_dir).withColumn("repo", F.concat(F.lit("/home/me/r"), F.col("repo").cast("string")))
    urls = runs.select("repo").distinct().withColumn("url", F.regexp_replace("repo", "^/home/me", "https://git.example.org"))
    return published(runs, urls, "/home/me").groupBy("repo").agg(F.count("*").alias("runs"))


