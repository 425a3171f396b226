"""Artifacts (files read and written, commands, errors) from messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which tool makes which kind of artifact (fixed values); tools named mcp_... are api calls.
ARTIFACT_OF_TOOL = {"Read": "file_read", "Glob": "file_read", "Grep": "file_read", "Edit": "file_write", "Write": "file_create", "Bash": "command"}
#: The argument that names a tool's target (fixed values); Grep's is its pattern and path, an api call's the tool.
ARGUMENT_OF_TOOL = {"Read": "file_path", "Glob": "pattern", "Edit": "file_path", "Write": "file_path", "Bash": "command"}
ERROR = "error|Error|ERROR"


def tool_arguments(content: Column) -> Column:
    """Arguments of a tool message as a map of strings: ``tool_use:Name(k=v, ...)`` or a JSON object; null if neither."""
    inside = F.regexp_extract(content, r"^tool_use:\w+\(([^)]*)\)", 1)
    pairs = F.str_to_map(F.regexp_replace(inside, "…", ""), F.lit(", "), F.lit("="))
    # Literals of Python's dicts: quotes of either kind are read anyway, its constants are spelled as JSON's.
    constant = lambda text, mine, other: F.regexp_replace(text, rf"([\[:,]\s*){mine}(?=\s*[\],}}])", f"$1{other}")
    literal = constant(constant(constant(content, "True", "true"), "False", "false"), "None", "null")
    read = lambda text: F.from_json(text, "map<string,string>", {"allowBackslashEscapingAnyCharacter": "true"})
    return F.when(content.startswith("tool_use:"), pairs).otherwise(F.coalesce(read(content), read(literal)))


def error_text(content: Column) -> Column:
    """The first 200 characters of an error message: plain text or the text blocks of a JSON list that name an error; else null."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    text = F.when(content.startswith("["), listed).when(content.startswith("{"), F.lit(None)).otherwise(content)
    return F.when(text.rlike(ERROR), F.substring(text, 1, 200))


def extract_artifacts(messages: DataFrame) -> DataFrame:
    """id, session_id, artifact_type, target, tool_name, sequence, context: a narrow map, nothing is shuffled."""
    api = F.col("tool_name").startswith("mcp_")
    lookup = lambda d: F.element_at(F.create_map(*(F.lit(x) for pair in d.items() for x in pair)), F.col("tool_name"))
    kind = F.when(api, "api_call").otherwise(lookup(ARTIFACT_OF_TOOL))
    args = tool_arguments(F.col("content"))
    searched = F.trim(F.concat_ws(" ", F.element_at(args, F.lit("pattern")), F.element_at(args, F.lit("path"))))
    target = F.when(api, F.col("tool_name")).when(F.col("tool_name") == "Grep", searched).otherwise(F.element_at(args, lookup(ARGUMENT_OF_TOOL)))
    tools = messages.where("tool_name is not null").select("id", "session_id", kind.alias("artifact_type"), F.nullif(target, F.lit("")).alias("target"), "tool_name", "sequence", F.lit(None).cast("string").alias("context"))
    errors = messages.where("tool_name is null").select("id", "session_id", F.lit("error").alias("artifact_type"), error_text(F.col("content")).alias("target"), "tool_name", "sequence", F.col("content").alias("context"))
    return tools.unionByName(errors).where("artifact_type is not null and target is not null")


def unique_artifacts(found: DataFrame) -> DataFrame:
    """One artifact for each session, type, target and place: that of the least id."""
    keys = ["session_id", "artifact_type", "target", "sequence"]
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.min(F.struct("id", *(c for c in rest if c != "id"))).alias("a")).select(*(f"a.{c}" if c in rest else c for c in found.columns))
