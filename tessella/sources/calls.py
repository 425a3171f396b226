"""Records of model-API calls and of experiments, from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import call_cost, project_of_prompt, token_estimate
from tessella.sources.transcripts import get


def _filled(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first value that is there and neither empty nor zero."""
    empty = F.lit("") if kind == "string" else F.lit(0).cast(kind)
    return F.coalesce(*(F.nullif(get(v, p, kind), empty) for p in paths))


def call_records(exchanges: DataFrame) -> DataFrame:
    """A call record for each exchange (id, timestamp, request, response: JSON texts; session_id and variant pass through if there).

    Responses that are no JSON give a record without counts.
    """
    q, r = F.try_parse_json("request"), F.try_parse_json("response")
    system = F.coalesce(F.array_join(F.filter(F.transform(get(q, "$.system", "array<variant>"), lambda b: get(b, "$.text")), lambda t: t.isNotNull()), " "), get(q, "$.system"), F.lit(""))
    uses = F.filter(get(r, "$.content", "array<variant>"), lambda b: get(b, "$.type") == "tool_use")
    base = exchanges.withColumns({
        "_q": q, "_r": r, "_s": system, "tools_used": F.coalesce(F.to_json(F.transform(uses, lambda b: get(b, "$.name"))), F.lit("[]")),
        **{n: F.coalesce(get(r, f"$.usage.{k}", "long"), F.lit(0)) for n, k in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cache_read_input_tokens"), ("cache_create_tokens", "cache_creation_input_tokens"))},
    })
    cost = call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_create_tokens"))
    extra = [F.col(c) if c in exchanges.columns else F.lit(None).cast("string").alias(c) for c in ("session_id", "enrichment_variant", "agent_type")]
    return base.select(
        "id", "timestamp", F.coalesce(get(F.col("_q"), "$.model"), get(F.col("_r"), "$.model")).alias("model"), token_estimate(F.col("_s")).alias("system_prompt_tokens"), F.coalesce(F.size(get(F.col("_q"), "$.messages", "array<variant>")), F.lit(0)).alias("message_count"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens", cost.alias("cost_estimate_usd"), "tools_used", get(F.col("_r"), "$.stop_reason").alias("stop_reason"), project_of_prompt(F.col("_s")).alias("project"),
        F.octet_length("request").alias("request_bytes"), F.octet_length("response").alias("response_bytes"), *extra)


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiments from JSON files, with names in either style and arms flat or nested, and their outcome (10 % of time decides between passing arms)."""
    v = F.col("v")
    both = lambda arm, *names: [p for n in names for p in (f"$.{arm}.{n}",)] + [f"$.{arm}_{names[-1]}"]
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v is not null").select(
        _filled(v, "$.experimentId", "$.experiment_id").alias("experiment_id"), _filled(v, "$.taskPrompt", "$.task_prompt", "$.task").alias("task_prompt"), _filled(v, "$.taskComplexity", "$.task_complexity").alias("task_complexity"),
        _filled(v, "$.repo", "$.repository").alias("repo"), F.coalesce(_filled(v, "$.agentType", "$.agent_type"), F.lit("claude")).alias("agent_type"), get(v, "$.model").alias("model"),
        *(x for arm in ("enriched", "baseline") for x in (
            _filled(v, *both(arm, "status")).alias(f"{arm}_status"), _filled(v, *both(arm, "correctionCycles", "cycles"), kind="long").alias(f"{arm}_cycles"), _filled(v, *both(arm, "durationMs", "duration_ms"), kind="long").alias(f"{arm}_duration_ms"),
            _filled(v, *both(arm, "costUsd", "cost_usd"), kind="double").alias(f"{arm}_cost_usd"), _filled(v, *both(arm, "sessionId", "session_id")).alias(f"{arm}_session_id"))))
    e, b, de, db = (F.coalesce(c, d) for c, d in ((F.col("enriched_status"), F.lit("")), (F.col("baseline_status"), F.lit("")), (F.col("enriched_duration_ms"), F.lit(0)), (F.col("baseline_duration_ms"), F.lit(0))))
    won = F.when((e == "passed") & (b != "passed"), "enriched_wins").when((b == "passed") & (e != "passed"), "baseline_wins").when(e != "passed", "inconclusive")
    won = won.when((db > 0) & ((db - de) * 100 > 10 * db), "enriched_wins").when((db > 0) & ((db - de) * 100 < -10 * db), "baseline_wins").otherwise("tie")
    return rows.withColumns({"outcome": won, "duration_delta_pct": F.when(db > 0, F.round((de - db) / db * 100, 1))})


def first_by_key(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def last_by_key(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """Insert-or-replace: the last row of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")
