"""The engine's tables as views of the driver's test tables.

There are no agent transcripts among the test data, so each table is derived
from what there is, in the same way here and in the oracle's SQL (``ORACLE``).
A deployment reads the same tables from Parquet instead (``stored``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import new_path
from tessella.operators.artifacts import extract_artifacts
from tessella.operators.inverted import Inverted
from tessella.plans.catalog import CONCEPTS
from tessella.sources import store, versions

TABLES = ("messages", "sessions", "artifacts", "calls", "worktrees", "cycles", "checkpoints", "experiments", "vectors", "corpus")
#: The test texts are invented words: these stand for the words that a deployment looks for.
CONCEPT_WORDS = (*CONCEPTS, "that", "with", "tion")
DECISION_WORDS = ("tion", "thon", "ther")
STEP_WORDS = ("tion", "ther")


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def _seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    size = F.floor(F.length("text") / 4).cast("long")
    day = F.concat(F.lit("2024-01-"), _two(1 + F.col("conv_id") % 28), F.lit("T"), _two(F.col("conv_id") % 24), F.lit(":"), _two(F.col("turn") % 60), F.lit(":00"))
    mine = F.col("role") == "assistant"
    chat = talk.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("c"), "conv_id").alias("session_id"), F.col("turn").alias("sequence"), "role", F.col("text").alias("content"), day.alias("timestamp"),
        F.lit(None).cast("string").alias("tool_name"), F.when(mine, 0).otherwise(size).cast("long").alias("token_usage_in"), F.when(mine, size).otherwise(0).cast("long").alias("token_usage_out"),
        (F.col("conv_id") % 7 * 10).alias("cache_read_tokens"), (F.col("turn") % 3 * 5).alias("cache_create_tokens"))
    path = F.concat(F.lit("/src/mod"), F.col("k") % 10, F.when(F.col("k") % 7 == 0, "/tests/test_f").otherwise("/f"), "k", F.lit(".py"))
    command = F.element_at(F.array(*map(F.lit, ("pytest -q", "git status", "ls -la", "cd /tmp", "npm run build"))), F.col("k") % 5 + 1)
    kind = F.col("event_type")
    content = (F.when(kind == "view", F.concat(F.lit("tool_use:Read(file_path="), path, F.lit(")"))).when(kind == "purchase", F.concat(F.lit("tool_use:Edit(file_path="), path, F.lit(", old_string=x)")))
               .when(kind == "signup", F.concat(F.lit("tool_use:Write(file_path="), path, F.lit(")"))).when(kind == "click", F.concat(F.lit("tool_use:Bash(command="), command, F.lit(")")))
               .otherwise(F.concat(F.lit("Error: step "), F.col("k") % 20, F.lit(" failed with code "), F.col("k") % 3)))
    tool = F.when(kind == "view", "Read").when(kind == "purchase", "Edit").when(kind == "signup", "Write").when(kind == "click", "Bash")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    work = _events(spark, sf_dir).select(
        (F.lit(1_000_000_000) + F.col("event_id")).alias("id"), F.concat(F.lit("e"), "user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("sequence"),
        F.when((kind == "error") & (F.col("event_id") % 2 == 0), "user").otherwise("assistant").alias("role"), content.alias("content"), _iso(F.col("ts")).alias("timestamp"), tool.alias("tool_name"),
        F.floor("value").cast("long").alias("token_usage_in"), F.floor(F.col("value") / 4).cast("long").alias("token_usage_out"), (F.col("event_id") % 5 * 100).alias("cache_read_tokens"), (F.col("event_id") % 3 * 10).alias("cache_create_tokens"))
    return chat.unionByName(work)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("session_id", 2, 20).cast("long")
    project = F.when(F.col("session_id").startswith("c"), F.concat(F.lit("-Users-dev-code-chat"), n % 4)).otherwise(F.concat(F.lit("-Users-dev-code-app"), n % 6))
    found = messages(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("message_count"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"))
    return found.select("session_id", F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("filepath"), project.alias("project"), "message_count", (F.col("message_count") * 1000 + n).alias("file_size_bytes"), "created_at", "updated_at")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_artifacts(messages(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, e, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    tools = F.when(kind == "view", '["Read"]').when(kind == "purchase", '["Edit"]').when(kind == "signup", '["Write","Read"]').when(kind == "click", '["Bash"]').otherwise("[]")
    return _events(spark, sf_dir).select(
        F.concat(F.lit("call-"), F.lpad(e.cast("string"), 12, "0")).alias("id"), _iso(F.col("ts")).alias("timestamp"), _seconds("ts").alias("ts_s"), F.concat(F.lit("m"), e % 2).alias("model"),
        (e * 7 % 1000).alias("input_tokens"), (e * 3 % 200).alias("output_tokens"), (e % 5 * 100).alias("cache_read_tokens"), (e % 3 * 10).alias("cache_create_tokens"), F.round(F.col("value") / 1000, 6).alias("cost_estimate_usd"),
        tools.alias("tools_used"), F.when(kind == "error", "error").when(kind == "click", "end_turn").otherwise("tool_use").alias("stop_reason"), F.lit(None).cast("string").alias("session_id"), F.concat(F.lit("proj"), u).alias("project"),
        F.when(u % 3 != 0, "v1_slim").alias("enrichment_variant"), F.when(u % 4 == 0, "builder").alias("agent_type"))


def worktrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "active").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("e"), F.col("o_custkey") % 200).alias("session_id"), F.concat(F.lit("fix/"), F.col("o_custkey") % 50).alias("branch_name"), status.alias("status"),
                    F.concat(F.lit("repair order "), F.col("o_custkey") % 97, F.lit(" webhook")).alias("task_description"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("ab_variant_label"), _iso(F.col("o_orderdate")).alias("created_at"),
                    _seconds("o_orderdate").alias("created_s"), F.when(status != "active", _seconds("o_orderdate") + F.col("o_custkey") % 200 * 86400).alias("resolved_s"), F.col("o_totalprice").alias("price"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    outcome = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "passed").otherwise("escalated")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("worktree_id"), F.col("l_linenumber").cast("long").alias("cycle_number"), F.concat(F.lit("Error in part "), F.col("l_partkey") % 50).alias("trigger_error"),
                    outcome.alias("outcome"), (F.floor("l_quantity").cast("long") * 10).alias("duration_seconds"), _iso(F.col("l_shipdate")).alias("created_at"), _seconds("l_shipdate").alias("created_s"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("worktree_id"), F.concat(F.lit("sha"), "l_suppkey").alias("git_sha"), F.concat(F.lit("/src/f"), F.col("l_partkey") % 20, F.lit(".py")).alias("file"), _seconds("l_shipdate").alias("created_s"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cycles of a worktree, one after the other, stand for the two arms of an experiment."""
    a, b = cycles(spark, sf_dir), cycles(spark, sf_dir)
    arm = lambda df, name, at: df.select("worktree_id", (F.col("cycle_number") - at).alias("n"), F.col("outcome").alias(f"{name}_status"), F.col("duration_seconds").alias(f"{name}_duration"))
    met = arm(a, "enriched", 0).join(arm(b, "baseline", 1), ["worktree_id", "n"])
    delta = F.when(F.col("baseline_duration") != 0, F.round((F.col("enriched_duration") - F.col("baseline_duration")) * 100.0 / F.col("baseline_duration"), 2))
    return met.select(F.concat("worktree_id", F.lit("-"), "n").alias("experiment_id"), "enriched_status", "baseline_status", "enriched_duration", "baseline_duration", delta.alias("duration_delta_pct"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("message_id"), "embedding")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("role"), F.col("source").alias("tool_name"))


#: Indexes of corpora that this process has built, by application, folder and whether words are stemmed.
_BUILT: dict[tuple, Inverted] = {}


def corpus_index(spark: SparkSession, sf_dir: str, stems: bool = False) -> Inverted:
    """The stored index of the corpus, built when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, stems)
    found = _BUILT.get(key)
    if found is None or not found.segments():
        found = Inverted(spark, new_path(spark, "search"), stems=stems)
        found.add(corpus(spark, sf_dir))
        _BUILT[key] = found
    return found


def bound(spark: SparkSession, sf_dir: str) -> dict:
    """Table name -> DataFrame, made when asked for."""
    makers = {name: globals()[name] for name in TABLES}

    class Lazy(dict):
        def __missing__(self, name: str) -> DataFrame:
            self[name] = makers[name](spark, sf_dir)
            return self[name]

    return Lazy()


def stored(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """The same tables as a deployment keeps them (``sources.store``), all of one version, opened when asked for."""
    at, held = versions.version(spark, path, number)

    class Lazy(dict):
        def search_index(self) -> Inverted:
            """The messages' search index."""
            return store.search_index(spark, path, held.get("notes", {}))

        def __missing__(self, name: str) -> DataFrame:
            found = versions.table(spark, path, name, at) if name in TABLES and at else None
            if found is None:
                raise KeyError(name)
            if name == "checkpoints" and "files" in found.columns:
                found = found.withColumn("file", F.explode_outer("files"))  # the plans take a row for each file
            self[name] = found
            return found

    return Lazy()


#: The views for DuckDB.
ORACLE = {
    "ev": "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events",
    "messages": """
SELECT conv_id * 1000 + turn AS id, 'c' || conv_id AS session_id, turn AS sequence, role, text AS content,
  '2024-01-' || lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(conv_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00' AS timestamp,
  CAST(NULL AS VARCHAR) AS tool_name, CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS token_usage_in, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS token_usage_out,
  conv_id % 7 * 10 AS cache_read_tokens, turn % 3 * 5 AS cache_create_tokens FROM conversations
UNION ALL
SELECT 1000000000 + event_id, 'e' || user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'user' ELSE 'assistant' END,
  CASE event_type WHEN 'view' THEN 'tool_use:Read(file_path=' || p || ')' WHEN 'purchase' THEN 'tool_use:Edit(file_path=' || p || ', old_string=x)' WHEN 'signup' THEN 'tool_use:Write(file_path=' || p || ')'
    WHEN 'click' THEN 'tool_use:Bash(command=' || ['pytest -q', 'git status', 'ls -la', 'cd /tmp', 'npm run build'][k % 5 + 1] || ')' ELSE 'Error: step ' || (k % 20) || ' failed with code ' || (k % 3) END,
  strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Write' WHEN 'click' THEN 'Bash' END,
  CAST(floor(value) AS BIGINT), CAST(floor(value / 4) AS BIGINT), event_id % 5 * 100, event_id % 3 * 10
FROM (SELECT *, '/src/mod' || (k % 10) || CASE WHEN k % 7 = 0 THEN '/tests/test_f' ELSE '/f' END || k || '.py' AS p FROM ev)""",
    "sessions": """
SELECT session_id, '/logs/' || session_id || '.jsonl' AS filepath, CASE WHEN session_id LIKE 'c%' THEN '-Users-dev-code-chat' || (n % 4) ELSE '-Users-dev-code-app' || (n % 6) END AS project,
  message_count, message_count * 1000 + n AS file_size_bytes, created_at, updated_at
FROM (SELECT session_id, CAST(substr(session_id, 2) AS BIGINT) AS n, count(*) AS message_count, min(timestamp) AS created_at, max(timestamp) AS updated_at FROM messages GROUP BY session_id)""",
    "artifacts": """
SELECT id, session_id, artifact_type, target, tool_name, sequence, context FROM (
  SELECT id, session_id, CASE tool_name WHEN 'Read' THEN 'file_read' WHEN 'Edit' THEN 'file_write' WHEN 'Write' THEN 'file_create' WHEN 'Bash' THEN 'command' END AS artifact_type,
    nullif(regexp_extract(content, '(file_path|command)=([^,)]*)', 2), '') AS target, tool_name, sequence, CAST(NULL AS VARCHAR) AS context FROM messages WHERE tool_name IS NOT NULL
  UNION ALL
  SELECT id, session_id, 'error', substr(content, 1, 200), tool_name, sequence, content FROM messages WHERE tool_name IS NULL AND regexp_matches(content, 'error|Error|ERROR'))
WHERE artifact_type IS NOT NULL AND target IS NOT NULL""",
    "calls": """
SELECT 'call-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, date_diff('second', TIMESTAMP '1970-01-01', ts) AS ts_s, 'm' || (event_id % 2) AS model,
  event_id * 7 % 1000 AS input_tokens, event_id * 3 % 200 AS output_tokens, event_id % 5 * 100 AS cache_read_tokens, event_id % 3 * 10 AS cache_create_tokens, round(value / 1000, 6) AS cost_estimate_usd,
  CASE event_type WHEN 'view' THEN '["Read"]' WHEN 'purchase' THEN '["Edit"]' WHEN 'signup' THEN '["Write","Read"]' WHEN 'click' THEN '["Bash"]' ELSE '[]' END AS tools_used,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'end_turn' ELSE 'tool_use' END AS stop_reason, CAST(NULL AS VARCHAR) AS session_id, 'proj' || user_id AS project,
  CASE WHEN user_id % 3 != 0 THEN 'v1_slim' END AS enrichment_variant, CASE WHEN user_id % 4 = 0 THEN 'builder' END AS agent_type FROM events""",
    "worktrees": """
SELECT o_orderkey AS id, 'e' || (o_custkey % 200) AS session_id, 'fix/' || (o_custkey % 50) AS branch_name, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'active' ELSE 'failed' END AS status,
  'repair order ' || (o_custkey % 97) || ' webhook' AS task_description, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS ab_variant_label, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
  date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS created_s, CASE WHEN o_orderstatus <> 'O' THEN date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) + o_custkey % 200 * 86400 END AS resolved_s,
  o_totalprice AS price FROM orders""",
    "cycles": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS worktree_id, CAST(l_linenumber AS BIGINT) AS cycle_number, 'Error in part ' || (l_partkey % 50) AS trigger_error,
  CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'passed' ELSE 'escalated' END AS outcome, CAST(floor(l_quantity) AS BIGINT) * 10 AS duration_seconds, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
  date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) AS created_s FROM lineitem""",
    "checkpoints": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS worktree_id, 'sha' || l_suppkey AS git_sha, '/src/f' || (l_partkey % 20) || '.py' AS file, date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) AS created_s FROM lineitem""",
    "experiments": """
SELECT a.l_orderkey || '-' || a.l_linenumber AS experiment_id, CASE a.l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'passed' ELSE 'escalated' END AS enriched_status,
  CASE b.l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'passed' ELSE 'escalated' END AS baseline_status, CAST(floor(a.l_quantity) AS BIGINT) * 10 AS enriched_duration, CAST(floor(b.l_quantity) AS BIGINT) * 10 AS baseline_duration,
  CASE WHEN floor(b.l_quantity) != 0 THEN round((floor(a.l_quantity) - floor(b.l_quantity)) * 100.0E0 / floor(b.l_quantity), 2) END AS duration_delta_pct
FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "vectors": "SELECT vec_id AS message_id, embedding FROM embeddings",
    "corpus": "SELECT doc_id AS id, text AS content, lang AS role, source AS tool_name FROM documents",
}
