"""Readers of agents' transcripts (JSON lines) into the message table, and sinks that keep it.

Lines are read as text and parsed as VARIANT, so a field may be a string in one
line and a list in the next; lines that are no JSON are dropped. Messages are
numbered per session in file order (the block's start, then the line in it).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "session_id string, sequence long, role string, content string, timestamp string, tool_name string, token_usage_in long, token_usage_out long, cache_read_tokens long, cache_create_tokens long, agent_id string"
#: Tool names of the function-call transcripts (fixed values).
TOOL_NAMES = {"exec_command": "Bash", "shell": "Bash", "write_file": "Write", "read_file": "Read", "apply_diff": "Edit", "create_file": "Write", "delete_file": "Delete"}
THINKING, OUTPUT = 500, 500
TRAIL_TOOLS = ("Write", "Edit", "Read", "Bash", "Glob", "Grep")


def lines(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """session_id (the file's name), project (its folder below ``projects``), place (order in the file), v (the parsed line)."""
    parse = F.parse_json if strict else F.try_parse_json
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)
    project = F.nullif(F.regexp_extract("file", r"/projects/([^/]+)/[^/]+$", 1), F.lit(""))
    kept = raw.where(F.trim("value") != "").select(name.alias("session_id"), project.alias("project"), "file", F.struct("block", F.monotonically_increasing_id().alias("line")).alias("place"), parse("value").alias("v"))
    return kept.where("v is not null")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def coerced(value: object) -> str:
    """Any JSON value as text: strings trimmed, a list's parts (an object's text or content) in lines, objects as JSON with sorted keys."""
    match value:
        case None:
            return ""
        case dict():
            return json.dumps(value, sort_keys=True)
        case list():
            told = ((x.get("text") or x.get("content") or x) if isinstance(x, dict) else x for x in value)
            return "\n".join(filter(None, map(coerced, told))).strip()
    return str(value).strip()


@F.pandas_udf(T.StringType())
def _coerced(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else coerced(json.loads(v)), na_action="ignore")


def as_text(v: Column) -> Column:
    """``coerced`` of a VARIANT: strings and nulls in the plan, lists and objects (at any depth) in Arrow batches."""
    plain = F.schema_of_variant(v) == "STRING"
    return F.when(v.isNull(), F.lit("")).when(plain, F.btrim(get(v, "$"), F.lit(" \t\n\r\f\x0b"))).otherwise(_coerced(F.when(~plain, F.to_json(v))))


def _blocks(message: Column) -> Column:
    return get(message, "$.content", "array<variant>")


def _text_of(block: Column) -> Column:
    """Text of a block: a string, a text block, or a tool result's own text blocks."""
    plain, kind = get(block, "$"), get(block, "$.type")
    inner = get(block, "$.content", "array<variant>")
    result = F.coalesce(F.array_join(F.filter(F.transform(inner, lambda b: F.coalesce(get(b, "$.text"), get(b, "$"))), lambda t: t.isNotNull()), "\n"), get(block, "$.content"))
    return F.when(kind == "text", F.coalesce(get(block, "$.text"), F.lit(""))).when(kind == "tool_result", result).when(kind.isNull(), plain)


def _joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")


def _collected(message: Column) -> Column:
    return F.coalesce(_joined(F.transform(_blocks(message), _text_of)), get(message, "$.content"), F.lit(""))


def _said(message: Column) -> Column:
    """An assistant's text and thinking (its first 500 characters)."""
    kind = lambda b: get(b, "$.type")
    text = lambda b: F.when(kind(b) == "thinking", F.nullif(F.substring(F.coalesce(get(b, "$.thinking"), get(b, "$.text")), 1, THINKING), F.lit(""))).when(kind(b) == "tool_use", None).otherwise(_text_of(b))
    return F.coalesce(F.trim(_joined(F.transform(_blocks(message), text))), get(message, "$.content"), F.lit(""))


def _calls(message: Column) -> Column:
    """Names and JSON inputs of an assistant's tool calls."""
    uses = F.filter(_blocks(message), lambda b: get(b, "$.type") == "tool_use")
    calls = F.transform(uses, lambda b: F.struct(F.coalesce(get(b, "$.name"), F.lit("unknown")).alias("name"), F.coalesce(F.to_json(get(b, "$.input", "variant")), F.lit("{}")).alias("input")))
    return F.coalesce(calls, F.array().cast("array<struct<name:string,input:string>>"))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("place", "part")
    return rows.withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))


def chat_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of chat transcripts: user, assistant, summary and sub-agent events.

    An assistant's event gives a row for its text and one for each tool call
    (its JSON input as content); the event's token counts stand in its first row.
    """
    return chat_rows(lines(spark, path)).drop("place")


def chat_rows(found: DataFrame) -> DataFrame:
    """``chat_messages`` of lines (session_id, project, file, place, v)."""
    agent = (get(F.col("v"), "$.type") == "progress") & (get(F.col("v"), "$.data.type") == "agent_progress")
    event = found.select("session_id", "project", "file", "place", "v", F.when(agent, get(F.col("v"), "$.data.message", "variant")).otherwise(F.col("v")).alias("e"), F.when(agent, get(F.col("v"), "$.data.agentId")).alias("agent_id"), get(F.col("v"), "$.timestamp").alias("outer"))
    event = event.select("session_id", "project", "file", "place", "v", "agent_id", get(F.col("e"), "$.type").alias("kind"), F.coalesce(get(F.col("e"), "$.timestamp"), "outer").alias("timestamp"), get(F.col("e"), "$.message", "variant").alias("m"))
    event = event.where("kind in ('user', 'assistant', 'summary')")
    m, v = F.col("m"), F.col("v")
    summary = F.coalesce(*(F.nullif(x, F.lit("")) for x in (get(v, "$.summary"), get(m, "$.summary"), _collected(m))))
    text = F.when(F.col("kind") == "user", _collected(m)).when(F.col("kind") == "assistant", _said(m)).otherwise(summary)
    calls = F.when(F.col("kind") == "assistant", _calls(m)).otherwise(F.array().cast("array<struct<name:string,input:string>>"))
    usage = {"token_usage_in": "input_tokens", "token_usage_out": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_create_tokens": "cache_creation_input_tokens"}
    tokens = [F.when(F.col("kind") == "user", 0).otherwise(F.coalesce(get(m, f"$.usage.{k}", "long"), F.lit(0))).cast("long").alias(n) for n, k in usage.items()]
    said = event.select("session_id", "project", "file", "place", "agent_id", "timestamp", F.col("kind").alias("role"), F.coalesce(text, F.lit("")).alias("text"), calls.alias("calls"), *tokens)
    part = "struct<content:string,tool_name:string>"
    own = F.when((F.col("text") != "") | (F.col("role") == "user"), F.array(F.struct(F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_name")))).otherwise(F.array().cast(f"array<{part}>"))
    tools = F.transform("calls", lambda c: F.struct(c["input"].alias("content"), c["name"].alias("tool_name")))
    rows = said.select("*", F.posexplode(F.concat(own, tools)).alias("part", "x"))
    # Inputs of tools are objects; their text has sorted keys at every depth.
    rows = rows.withColumn("x", F.struct(F.when(F.col("x.tool_name").isNotNull(), _coerced(F.when(F.col("x.tool_name").isNotNull(), F.col("x.content")))).otherwise(F.col("x.content")).alias("content"), F.col("x.tool_name").alias("tool_name")))
    first = [F.when(F.col("part") == 0, F.col(n)).otherwise(0).cast("long").alias(n) for n in usage]
    return _numbered(rows).select("session_id", "project", "sequence", "role", "x.content", "timestamp", "x.tool_name", *first, "agent_id", "file", F.struct("place", "part").alias("place"))


def call_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of function-call transcripts; tokens counted since the last message go to the next one, outputs to their calls."""
    found = lines(spark, path)
    p = get(F.col("v"), "$.payload", "variant")
    event = found.select("session_id", "file", "place", get(F.col("v"), "$.type").alias("type"), get(F.col("v"), "$.timestamp").alias("timestamp"), p.alias("p"), get(p, "$.type").alias("kind"))
    meta = event.where("type = 'session_meta'").groupBy("session_id").agg(F.min_by(get(F.col("p"), "$.id"), "place").alias("id"), F.min_by(get(F.col("p"), "$.cwd"), "place").alias("cwd"))
    message = (F.col("type") == "response_item") & (F.col("kind") == "message")
    text = F.when(message, _joined(F.transform(get(F.col("p"), "$.content", "array<variant>"), lambda b: F.nullif(F.coalesce(get(b, "$.text"), get(b, "$")), F.lit("")))))
    text = F.when(F.col("kind") == "agent_reasoning", F.concat(F.lit("[reasoning] "), F.nullif(get(F.col("p"), "$.text"), F.lit("")))).otherwise(F.nullif(text, F.lit("")))
    event = event.withColumn("text", text).withColumn("is_message", message & F.col("text").isNotNull())
    counted = F.when(F.col("kind") == "token_count", F.struct((F.coalesce(get(F.col("p"), "$.info.total_token_usage.input_tokens", "long"), F.lit(0)) + F.coalesce(get(F.col("p"), "$.info.total_token_usage.cached_input_tokens", "long"), F.lit(0))).alias("i"), F.coalesce(get(F.col("p"), "$.info.total_token_usage.output_tokens", "long"), F.lit(0)).alias("o")))
    before = Window.partitionBy("session_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    event = event.withColumn("group", F.coalesce(F.sum(F.col("is_message").cast("int")).over(before), F.lit(0))).withColumn("counted", counted)
    since = Window.partitionBy("session_id", "group").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    event = event.withColumn("tokens", F.when(F.col("is_message"), F.last("counted", ignorenulls=True).over(since)))
    calls = event.where("type = 'response_item' and kind = 'function_call'").withColumn("call_id", get(F.col("p"), "$.call_id"))
    outputs = event.where("kind = 'function_call_output'").groupBy("session_id", get(F.col("p"), "$.call_id").alias("call_id")).agg(F.max_by(F.substring(get(F.col("p"), "$.output"), 1, OUTPUT), "place").alias("output"))
    name = get(F.col("p"), "$.name")
    tool = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in TOOL_NAMES.items() for x in pair)), name), name, F.lit("unknown"))
    arguments = get(F.col("p"), "$.arguments")
    tools = calls.join(outputs, ["session_id", "call_id"], "left").select("session_id", "file", "place", "timestamp", F.lit("assistant").alias("role"), F.coalesce(arguments, F.lit("{}")).alias("content"), tool.alias("tool_name"), F.lit(0).cast("long").alias("token_usage_in"), F.lit(0).cast("long").alias("token_usage_out"), F.nullif("output", F.lit("")).alias("output"))
    role = F.when(F.col("is_message"), F.coalesce(get(F.col("p"), "$.role"), F.lit("assistant"))).otherwise("assistant")
    texts = event.where("text is not null").select("session_id", "file", "place", "timestamp", role.alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_name"), F.coalesce("tokens.i", F.lit(0)).cast("long").alias("token_usage_in"), F.coalesce("tokens.o", F.lit(0)).cast("long").alias("token_usage_out"), F.lit(None).cast("string").alias("output"))
    rows = _numbered(tools.unionByName(texts).withColumn("part", F.lit(0))).join(meta, "session_id", "left")
    return rows.select(F.coalesce("id", "session_id").alias("session_id"), F.element_at(F.split("cwd", "/"), -1).alias("project"), "sequence", "role", "content", "timestamp", "tool_name", "token_usage_in", "token_usage_out", "output", "file")


def editor_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of editor hook events; a line that is no JSON is an error."""
    found = lines(spark, path, strict=True)
    v = F.col("v")
    kind, file = F.coalesce(get(v, "$.hook_type"), get(v, "$.type")), F.coalesce(get(v, "$.file_path"), get(v, "$.path"), F.lit("unknown"))
    command = F.coalesce(get(v, "$.command"), F.lit(""))
    part = lambda text, tool, role, output: F.array(F.struct(F.lit(role).alias("role"), text.alias("content"), F.lit(tool).cast("string").alias("tool_name"), output.alias("output")))
    none = F.lit(None).cast("string")
    cut = lambda field: F.nullif(F.substring(get(v, field), 1, OUTPUT), F.lit(""))
    stop = part(F.coalesce(get(v, "$.conversation"), get(v, "$.summary"), F.lit("Session ended")), None, "summary", none)
    edit = F.concat(part(F.concat(F.lit("Edited "), file), None, "assistant", none), part(F.to_json(F.struct(file.alias("file_path"))), "Edit", "assistant", cut("$.diff")))
    shell = F.concat(part(F.concat(F.lit("Ran: "), command), None, "assistant", none), part(F.to_json(F.struct(command.alias("command"))), "Bash", "assistant", cut("$.output")))
    parts = F.when(kind == "stop", stop).when(kind == "afterFileEdit", edit).when(kind == "afterShellExecution", shell)
    rows = found.select("session_id", "file", "place", get(v, "$.timestamp").alias("timestamp"), F.posexplode(parts).alias("part", "x"))
    return _numbered(rows).select("session_id", "sequence", "x.role", "x.content", "timestamp", "x.tool_name", "x.output", "file")


def _since_first() -> Column:
    """Minutes and seconds since the first row of the session; null without a time."""
    at = F.try_to_timestamp("timestamp")
    first = F.min_by(at, "sequence").over(Window.partitionBy("session_id"))
    passed = F.floor(F.unix_micros(at) / 1_000_000 - F.unix_micros(first) / 1_000_000).cast("long")
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return F.concat(two(F.floor(passed / 60)), F.lit(":"), two(F.pmod(passed, F.lit(60))))


def trail(spark: SparkSession, path: str) -> DataFrame:
    """The tool calls of chat transcripts with their results: sequence, timestamp, tool, file, command, exit code and error, and the time since the session's first call as mm:ss."""
    from tessella.functions.text import exit_code

    found = lines(spark, path).select("session_id", "place", get(F.col("v"), "$.type").alias("kind"), get(F.col("v"), "$.timestamp").alias("timestamp"), F.posexplode(get(F.col("v"), "$.message.content", "array<variant>")).alias("part", "b"))
    b = F.col("b")
    uses = found.where((F.col("kind") == "assistant") & (get(b, "$.type") == "tool_use") & get(b, "$.name").isin(*TRAIL_TOOLS)).select("session_id", "place", "part", "timestamp", get(b, "$.id").alias("id"), get(b, "$.name").alias("name"), get(b, "$.input", "variant").alias("i"))
    uses = uses.withColumn("sequence", F.row_number().over(Window.partitionBy("session_id").orderBy("place", "part")))
    uses = uses.withColumn("again", F.row_number().over(Window.partitionBy("session_id", "id").orderBy(F.desc("sequence")))).where("again = 1")
    content = F.coalesce(_joined(F.transform(get(b, "$.content", "array<variant>"), lambda x: get(x, "$.text"))), get(b, "$.content"), F.lit(""))
    results = found.where((F.col("kind") == "user") & (get(b, "$.type") == "tool_result")).select("session_id", get(b, "$.tool_use_id").alias("id"), F.struct("place", "part").alias("at"), F.struct(content.alias("output"), F.coalesce(get(b, "$.is_error", "boolean"), F.lit(False)).alias("failed")).alias("r"))
    results = results.groupBy("session_id", "id").agg(F.max_by("r", "at").alias("r"))
    i, output, failed = F.col("i"), F.coalesce("r.output", F.lit("")), F.coalesce("r.failed", F.lit(False))
    code = F.when(F.col("name") == "Bash", exit_code(output, failed))
    file = F.when(F.col("name").isin("Glob", "Grep"), F.coalesce(get(i, "$.path"), get(i, "$.file_path"))).otherwise(get(i, "$.file_path"))
    named = output.rlike(r"^Exit code \d+") & (F.col("name") == "Bash")
    return uses.join(results, ["session_id", "id"], "left").select("session_id", "sequence", "timestamp", F.upper("name").alias("tool"), file.alias("file_path"), get(i, "$.command").alias("command"), get(i, "$.old_string").alias("old_content"), F.coalesce(get(i, "$.new_string"), get(i, "$.content")).alias("new_content"), code.alias("exit_code"), F.when(named, code != 0).otherwise(failed).alias("is_error")).withColumn("since_first", _since_first())


def sse_usage(streams: DataFrame) -> DataFrame:
    """id, model, stop_reason, four token counts and tool names of recorded event streams (id, raw)."""
    events = streams.select("id", F.posexplode(F.split("raw", "\n\n")).alias("at", "event"))
    fields = F.split("event", "\n")
    last = lambda mark: F.element_at(F.filter(fields, lambda x: x.startswith(mark)), -1)
    has = F.size(F.filter(fields, lambda x: x.startswith("data: "))) > 0
    events = events.where(has).select("id", "at", F.trim(F.substring(F.try_element_at(F.filter(fields, lambda x: x.startswith("event: ")), F.lit(-1)), 8, 1000)).alias("kind"), F.try_parse_json(F.substring(last("data: "), 7, 10_000_000)).alias("v")).where("v is not null")
    v = F.col("v")
    start, delta = F.col("kind") == "message_start", F.col("kind") == "message_delta"
    latest = lambda when, value: F.max_by(value, F.when(when & value.isNotNull(), F.col("at")))
    count = lambda when, path: F.coalesce(latest(when, F.nullif(get(v, path, "long"), F.lit(0))), F.lit(0)).cast("long")
    tool = F.when((F.col("kind") == "content_block_start") & (get(v, "$.content_block.type") == "tool_use") & (get(v, "$.content_block.name") != ""), F.struct("at", get(v, "$.content_block.name").alias("name")))
    found = events.groupBy("id").agg(latest(start, get(v, "$.message.model")).alias("model"), latest(delta, get(v, "$.delta.stop_reason")).alias("stop_reason"), count(start, "$.message.usage.input_tokens").alias("input_tokens"), count(delta, "$.usage.output_tokens").alias("output_tokens"), count(start, "$.message.usage.cache_read_input_tokens").alias("cache_read_tokens"), count(start, "$.message.usage.cache_creation_input_tokens").alias("cache_create_tokens"), F.transform(F.array_sort(F.collect_list(tool)), lambda t: t["name"]).alias("tools"))
    return streams.select("id").join(found, "id", "left")


def discovered(spark: SparkSession, path: str, since: str | None = None, newest: bool = False) -> DataFrame:
    """Transcript files, the largest (or newest) first: path, file (as ``lines`` names it), length, modified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path).select("path", F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    return (files.where(F.col("modified") >= F.lit(since).cast("timestamp")) if since else files).orderBy(F.desc("modified" if newest else "length"), "path")


def merged_messages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new messages, the new one where both have a session's sequence number."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("session_id", "sequence").orderBy(F.desc("_new"))
    return both.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_new", "_at")


def merged_by_key(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of either side, one a key, with each column's new value, or the stored one where that is null."""
    columns = [c for c in stored.columns if c != key]
    met = stored.alias("s").join(new.alias("n"), key, "full_outer")
    return met.select(key, *(F.coalesce(f"n.{c}" if c in new.columns else F.lit(None), f"s.{c}").alias(c) for c in columns))


def merged_sessions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Session rows with each column's new value, or the stored one where that is null."""
    return merged_by_key(stored, new, "session_id")


def exported(df: DataFrame, path: str, form: str = "json") -> None:
    """Writes a result as JSON lines or CSV with a header."""
    (df.write.option("header", "true").csv(path) if form == "csv" else df.write.json(path))
