"""Session logs, one JSON row a content block, as tables of requests, commit calls, touched files and parse counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentmeter.functions import text as tx

SYNTHETIC = "<synthetic>"
_BLOCK = "struct<type:string,id:string,name:string,text:string,tool_use_id:string,input:struct<command:string,file_path:string,notebook_path:string>>"
_USAGE = "struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint,cache_creation:struct<ephemeral_1h_input_tokens:bigint>,output_tokens_details:struct<thinking_tokens:bigint>>"
ROW = f"type string, sessionId string, cwd string, timestamp string, isSidechain boolean, version string, requestId string, message struct<id:string,model:string,role:string,content:string,usage:{_USAGE}>, _bad string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(value, file_path) of every line under path."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file_path"))


def parsed(raw: DataFrame) -> DataFrame:
    """raw lines decoded and classed: corrupt, other, synthetic, bad_shape or usage; content blocks stay as JSON.

    Only lines that can matter are decoded: those that hold usage or a tool's use or result.
    """
    useful = F.col("value").contains('"usage"') | F.col("value").contains('"tool_use"') | F.col("value").contains('"tool_result"')
    row = F.when(useful, F.from_json("value", ROW, {"columnNameOfCorruptRecord": "_bad"}))
    # As a generated column the decoded row stays below any filter on it; else Catalyst decodes once for each mention in the filter.
    p = raw.where(F.length(F.trim("value")) > 0).select("*", F.explode(F.array(row)).alias("r"))
    u = F.col("r.message.usage")
    tokens = [F.coalesce(u[c], F.lit(0)) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")]
    negative = F.least(*tokens) < 0
    key = tx.request_key(F.col("r.requestId"), F.col("r.sessionId"), F.col("r.message.id"))
    corrupt = ~F.rtrim("value").endswith("}") | ~F.ltrim("value").startswith("{") | F.col("r._bad").isNotNull()
    usage_row = (F.col("r.type") == "assistant") & u.isNotNull()
    kind = (
        F.when(corrupt, "corrupt").when(~F.coalesce(usage_row, F.lit(False)), "other").when(F.col("r.message.model") == SYNTHETIC, "synthetic")
        .when(negative | key.isNull() | tx.parse_ts(F.col("r.timestamp")).isNull(), "bad_shape").otherwise("usage")
    )
    return p.select("file_path", "r", kind.alias("kind"), key.alias("request_id"), tx.parse_ts(F.col("r.timestamp")).alias("ts"))


def request_rows(rows: DataFrame) -> DataFrame:
    """Usage rows as requests, copies and all; thinking counts as output, one-hour writes are at most all writes."""
    u = F.col("r.message.usage")
    n = lambda c: F.coalesce(c, F.lit(0))
    write = n(u["cache_creation_input_tokens"])
    return rows.where("kind = 'usage'").select(
        "request_id", F.col("r.sessionId").alias("session_id"), F.col("r.message.model").alias("model"), "ts", n(u["input_tokens"]).alias("fresh_in"), write.alias("cache_write"),
        n(u["cache_read_input_tokens"]).alias("cache_read"), (n(u["output_tokens"]) + n(u["output_tokens_details"]["thinking_tokens"])).alias("output"),
        F.least(n(u["cache_creation"]["ephemeral_1h_input_tokens"]), write).alias("cache_write_1h"), F.col("r.cwd").alias("cwd"), F.coalesce(F.col("r.isSidechain"), F.lit(False)).alias("is_sidechain"), "file_path",
    )


def blocks(rows: DataFrame) -> DataFrame:
    """One row a content block."""
    content = F.from_json("r.message.content", f"array<{_BLOCK}>")
    return rows.where("kind <> 'corrupt'").select(F.col("r.sessionId").alias("session_id"), F.col("r.cwd").alias("cwd"), "ts", F.explode(content).alias("b")).select("session_id", "cwd", "ts", "b.*")


def commit_calls(content: DataFrame) -> DataFrame:
    """(session_id, cwd, start_ts, end_ts): shell calls that commit, with the first result after them; null if none came.

    Calls and results are taken out in one pass and meet in one shuffle.
    """
    call, result = (F.col("type") == "tool_use") & (F.col("name") == "Bash") & tx.is_commit(F.col("input.command")), F.col("type") == "tool_result"
    own = content.where(call | (result & F.col("tool_use_id").isNotNull() & F.col("session_id").isNotNull()))
    own = own.select("session_id", F.when(result, F.col("tool_use_id")).otherwise(F.col("id")).alias("id"), "ts", (~result).alias("call"), F.when(~result, tx.commit_dir(F.col("input.command"), F.col("cwd"))).alias("cwd"))
    both = Window.partitionBy("session_id", "id")
    met = own.withColumns({"start_ts": F.min(F.when(F.col("call"), F.col("ts"))).over(both), "calls": F.max("call").over(both)}).where("calls")
    met = met.groupBy("session_id", "id").agg(F.min("start_ts").alias("start_ts"), F.min_by("cwd", F.when(F.col("call"), F.col("ts"))).alias("cwd"), F.min(F.when(~F.col("call") & (F.col("ts") >= F.col("start_ts")), F.col("ts"))).alias("end_ts"))
    return met.select("session_id", "cwd", "start_ts", "end_ts")


def touched(content: DataFrame) -> DataFrame:
    """Distinct (session_id, cwd, path) of files that tools edit and shell commands write.

    One pass; a command that a session repeats is read once.
    """
    use = content.where("type = 'tool_use'")
    edit, command = tx.edit_target(F.col("name"), F.col("input.file_path"), F.col("input.notebook_path")), F.when(F.col("name") == "Bash", F.col("input.command"))
    use = use.select("session_id", "cwd", edit.alias("edit"), command.alias("command")).where("edit IS NOT NULL OR command IS NOT NULL").distinct()
    shell = F.coalesce(tx.written_paths(F.col("command")), F.array().cast("array<string>"))
    return use.select("session_id", "cwd", F.explode(F.concat(F.array_compact(F.array("edit")), shell)).alias("path")).distinct()


def parse_stats(rows: DataFrame) -> DataFrame:
    """(kind, n), and coverage: usage rows over usage and bad ones; 1 if there are none."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame) -> DataFrame:
    kept, lost = F.count_if(F.col("kind") == "usage"), F.count_if(F.col("kind").isin("bad_shape", "corrupt"))
    return rows.agg(kept.alias("kept"), lost.alias("skipped")).withColumn("coverage", F.coalesce(F.try_divide(F.col("kept"), F.col("kept") + F.col("skipped")), F.lit(1.0)))


def versions(rows: DataFrame) -> DataFrame:
    return rows.where("r.version IS NOT NULL").groupBy(F.col("r.version").alias("version")).agg(F.count("*").alias("n"))


def typed_prompts(messages: DataFrame) -> DataFrame:
    """Messages (session_id, ts, role, text, is_sidechain) that a person typed, white space collapsed; injected ones start with < or [."""
    typed = messages.where((F.col("role") == "user") & ~F.col("is_sidechain") & (F.length(F.trim("text")) > 0) & ~F.ltrim("text").startswith("<") & ~F.ltrim("text").startswith("[")) 
    return typed.select("session_id", "ts", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("prompt"))


def merged(*sources: DataFrame) -> DataFrame:
    """Requests of several agents in one table; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
