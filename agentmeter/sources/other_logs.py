"""Other inputs: rollout logs, usage exports, patch logs, run results, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentmeter.functions import text as tx

# Names in the inputs.
REQUIRED = ("Date", "Model", "Input (w/ Cache Write)", "Input (w/o Cache Write)", "Cache Read", "Output Tokens")
CALLS = ("function_call", "custom_tool_call", "local_shell_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "local_shell_call_output")
_LAST = "last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,cache_write_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"
ROLLOUT = f"timestamp string, type string, payload struct<session_id:string,id:string,cwd:string,cli_version:string,model:string,type:string,call_id:string,info:struct<{_LAST}>>"


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file_path"))


def rollout_rows(raw: DataFrame) -> DataFrame:
    """Rollout lines (value, file_path) in time order with the session, directory and model last seen before each in its file."""
    p = raw.select("file_path", "value", F.explode(F.array(F.from_json("value", ROLLOUT))).alias("r")).select("file_path", "value", "r.*").withColumn("ts", tx.parse_ts(F.col("timestamp")))
    order = Window.partitionBy("file_path").orderBy("ts", "value").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    meta, turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    return p.select(
        "file_path", "value", "ts", "type", "payload", last(F.when(meta, F.coalesce("payload.session_id", "payload.id"))).alias("session"), last(F.when(meta | turn, F.col("payload.cwd"))).alias("cwd"),
        last(F.when(turn, F.col("payload.model"))).alias("model"),
    )


def rollout_usage(rows: DataFrame) -> DataFrame:
    """Token counts as requests: cached and written input taken off the whole, reasoning counted as output; negative counts are skipped."""
    u = F.col("payload.info.last_token_usage")
    n = lambda c: F.coalesce(u[c], F.lit(0))
    cached, written, total = n("cached_input_tokens"), n("cache_write_input_tokens"), n("input_tokens")
    fine = F.least(cached, written, total, n("output_tokens"), n("reasoning_output_tokens")) >= 0
    counts = rows.where((F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & F.col("ts").isNotNull() & u.isNotNull()).where(fine)
    numbered = counts.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("ts", "value")))
    return numbered.select(
        F.concat_ws(":", F.lit("rollout"), "session", F.col("n").cast("string")).alias("request_id"), F.concat(F.lit("rollout:"), "session").alias("session_id"), F.coalesce("model", F.lit("unknown")).alias("model"), "ts",
        F.greatest(F.lit(0), total - cached - written).alias("fresh_in"), written.alias("cache_write"), cached.alias("cache_read"), (n("output_tokens") + n("reasoning_output_tokens")).alias("output"), "cwd",
    )


def rollout_calls(rows: DataFrame) -> DataFrame:
    """(session_id, cwd, start_ts, end_ts): commands that commit, with their output's time."""
    item = rows.where("type = 'response_item' AND ts IS NOT NULL")
    payload = F.get_json_object("value", "$.payload")
    call = item.where(F.col("payload.type").isin(*CALLS)).withColumn("command", tx.call_command(payload)).where(tx.is_commit(F.col("command")))
    starts = call.select("file_path", F.coalesce("payload.call_id", "payload.id").alias("call"), F.concat(F.lit("rollout:"), "session").alias("session_id"), tx.commit_dir(F.col("command"), F.col("cwd")).alias("cwd"), F.col("ts").alias("start_ts"))
    ends = item.where(F.col("payload.type").isin(*OUTPUTS)).select("file_path", F.col("payload.call_id").alias("call"), F.col("ts").alias("end_ts"))
    return starts.join(ends, ["file_path", "call"]).select("session_id", "cwd", "start_ts", "end_ts")


def read_usage_csv(spark: SparkSession, path: str) -> DataFrame:
    """A usage export as text columns, headers trimmed; a missing column is an error."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"not a usage export, these columns are missing: {', '.join(missing)}")
    return df if "User" in df.columns else df.withColumn("User", F.lit(None).cast("string"))


def _whole(c: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(try_cast(replace(`{c}`, ',', '') AS DOUBLE) AS BIGINT)"), F.lit(0).cast("long"))


def usage_rows(export: DataFrame, user: str | None = None) -> DataFrame:
    """Requests of a usage export: bad numbers are 0, rows without tokens, with negative ones or bad dates go, repeats fold to one."""
    rows = export if user is None else export.where(F.coalesce(F.col("User") == user, F.lit(True)))
    u = rows.select(
        "Date", "User", "Model", tx.parse_ts(F.col("Date")).alias("ts"), _whole("Input (w/o Cache Write)").alias("fresh_in"), _whole("Input (w/ Cache Write)").alias("cache_write"), _whole("Cache Read").alias("cache_read"), _whole("Output Tokens").alias("output")
    )
    fine = u.where("ts IS NOT NULL AND least(fresh_in, cache_write, cache_read, output) >= 0 AND fresh_in + cache_write + cache_read + output > 0").dropDuplicates(["Date", "User", "Model", "fresh_in", "cache_write", "cache_read", "output"])
    return fine.select(F.concat(F.lit("export:"), F.coalesce("User", F.lit("me"))).alias("session_id"), tx.normal_model(F.trim("Model")).alias("model"), "ts", "fresh_in", "cache_write", "cache_read", "output")


def read_patch_log(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each commit's record of a patch log; records start with \\x1e at the start of a line."""
    return spark.read.option("lineSep", "\n\x1e").text(path).select(F.regexp_replace("value", "^\x1e", "").alias("value"))


def patch_lines(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, files, lines) of patch-log records: a header of fields parted by \\x1f, numstat rows, then the patch.

    Lines count from 4 characters without white space at the ends. The path of a line is the last one named before it.
    """
    rows = records.select(F.split("value", "\n").alias("l")).withColumn("h", F.split(F.col("l")[0], "\x1f"))
    head = [F.get("h", F.lit(i)) for i in range(4)]
    commits = rows.select(head[0].alias("sha"), F.timestamp_seconds(head[1].cast("long")).alias("ts"), head[2].alias("author_email"), head[3].alias("subject"))
    each = rows.select(head[0].alias("sha"), F.posexplode("l").alias("pos", "line")).where("pos > 0")
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    number = lambda i: F.coalesce(F.expr("try_cast(regexp_extract(line, '" + stat.replace("\\", "\\\\") + f"', {i}) AS BIGINT)"), F.lit(0).cast("long"))
    files = each.where(F.col("line").rlike(stat)).select("sha", F.regexp_extract("line", stat, 3).alias("path"), number(1).alias("added"), number(2).alias("deleted"))
    named = F.when(F.col("line").startswith("+++ b/") | F.col("line").startswith("--- a/"), F.substring("line", 7, 1 << 30))
    path = F.last(named, ignorenulls=True).over(Window.partitionBy("sha").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    body = F.trim(F.substring("line", 2, 1 << 30))
    side = F.substring("line", 1, 1)
    marked = each.withColumn("path", path).where(~F.col("line").rlike(r"^(\+\+\+|---) ") & side.isin("+", "-") & ~F.col("line").rlike(stat))
    lines = marked.select("sha", "path", side.alias("side"), body.alias("line")).where(F.length("line") >= 4).distinct()
    return commits, files, lines


RUN = "run_id string, repo string, commit string, setup string, repeat int, outcome string, passed boolean, model string, cost_usd double, wall_s double, usages array<array<bigint>>, tokens_check string, cost_known boolean, agent string, note string, excluded_commit string, reason string"


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, excluded) of run results, one JSON object a line."""
    rows = spark.read.schema(RUN).json(path)
    return rows.where("excluded_commit IS NULL").drop("excluded_commit", "reason"), rows.where("excluded_commit IS NOT NULL").select(F.col("excluded_commit").alias("commit"), "reason")


def upload_files(files: DataFrame) -> DataFrame:
    """(submitter, file_name, sha256, size, text) of files (path, content) named records/<submitter>/<sha256>.json."""
    part = lambda i: F.element_at(F.split("path", "/"), F.lit(-i))
    return files.select(part(2).alias("submitter"), F.regexp_replace(part(1), r"\.json$", "").alias("file_name"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size"), F.decode("content", "UTF-8").alias("text"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    return upload_files(files)
