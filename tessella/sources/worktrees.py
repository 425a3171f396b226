"""Worktrees, their correction cycles and checkpoints, calls and their measures in a store.

Every function is one change of the store (``versions``). Rows come as a
DataFrame of any size; columns that a table does not have are left out, those
that rows lack are null or have the default. Empty rows change nothing.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ranges import running
from tessella.functions.shared import discard, written
from tessella.sources.versions import Change, changed

#: States of a worktree, those that end it, and outcomes of a cycle.
STATUSES = ("active", "passed", "failed", "escalated", "merged")
FINAL = ("passed", "failed", "escalated", "merged")
OUTCOMES = ("passed", "failed", "escalated")

#: Columns that a caller gives, by table.
WORKTREES = "session_id string, branch_name string, base_branch string, status string, task_description string, ab_variant_label string, ab_brief_metadata string, results_json string, created_at string, resolved_at string"
CYCLES = "worktree_id long, cycle_number long, trigger_error string, error_context string, checkpoint_id long, agent_session_id string, outcome string, duration_seconds long, created_at string"
CHECKPOINTS = "worktree_id long, session_id string, git_sha string, test_results string, artifact_snapshot string, graph_delta string, ab_variant_label string, label string, files array<string>, created_at string"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _seconds(time: str) -> Column:
    return F.unix_seconds(F.try_to_timestamp(F.col(time)))


def _shaped(rows: DataFrame, columns: str, defaults: dict[str, str]) -> DataFrame:
    """``rows`` with exactly the columns of a table, in its types."""
    pairs = [c.strip().split(" ", 1) for c in columns.split(",")]
    value = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    return rows.select(*((F.coalesce(value(c, kind), F.lit(defaults[c])) if c in defaults else value(c, kind)).alias(c) for c, kind in pairs))


def _refuse(rows: DataFrame, wrong: Column, what: str) -> None:
    if bad := rows.where(wrong).count():
        raise ValueError(f"{bad} rows {what}")


def _added(spark: SparkSession, store: str, name: str, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Appends ``rows`` (written) with ids that follow the greatest stored one, in ``order``; returns them with their ids."""

    def do(change: Change) -> DataFrame:
        held = change.table(name)
        top = 0 if held is None else held.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        counted = running(rows, [F.col(c) for c in order], {"before": F.lit(1)})
        out = written(counted.withColumn("id", (F.lit(top) + F.col("before") + 1).cast("long")).drop("before"), name)
        change.append(name, out, key)
        return out

    added = changed(spark, store, do)
    discard(rows)
    return added


def add_worktrees(spark: SparkSession, store: str, rows: DataFrame, now: str | None = None) -> DataFrame:
    """Adds worktrees (``WORKTREES``), of base ``main``, active and made now if not said; returns them with their ids.

    Refuses rows without a branch or of an unknown status, and then adds none.
    """
    shaped = _shaped(rows, WORKTREES, {"base_branch": "main", "status": "active", "created_at": now or _now()})
    new = written(shaped.withColumns({"created_s": _seconds("created_at"), "resolved_s": _seconds("resolved_at")}), "worktrees")
    _refuse(new, F.col("branch_name").isNull(), "have no branch")
    _refuse(new, ~F.col("status").isin(*STATUSES), "have an unknown status")
    return _added(spark, store, "worktrees", new, "id", ["created_s", "branch_name"])


def add_cycles(spark: SparkSession, store: str, rows: DataFrame, now: str | None = None) -> DataFrame:
    """Adds correction cycles (``CYCLES``); refuses rows without worktree or number or with an unknown outcome (none yet: null)."""
    new = written(_shaped(rows, CYCLES, {"created_at": now or _now()}).withColumn("created_s", _seconds("created_at")), "cycles")
    _refuse(new, F.col("worktree_id").isNull() | F.col("cycle_number").isNull(), "have no worktree or number")
    _refuse(new, ~F.col("outcome").isin(*OUTCOMES), "have an unknown outcome")
    return _added(spark, store, "cycles", new, "worktree_id", ["worktree_id", "cycle_number", "created_s"])


def add_checkpoints(spark: SparkSession, store: str, rows: DataFrame, now: str | None = None) -> DataFrame:
    """Adds checkpoints (``CHECKPOINTS``), whose ``files`` are those of their snapshot; refuses rows without worktree."""
    new = written(_shaped(rows, CHECKPOINTS, {"created_at": now or _now()}).withColumn("created_s", _seconds("created_at")), "checkpoints")
    _refuse(new, F.col("worktree_id").isNull(), "have no worktree")
    return _added(spark, store, "checkpoints", new, "worktree_id", ["worktree_id", "created_s"])


def _update_known(spark: SparkSession, store: str, rows: DataFrame) -> int:
    """Sets what is not null in ``rows`` (written, one an id) on the worktrees that are stored; returns how many those are."""

    def do(change: Change) -> int:
        held = change.table("worktrees")
        if held is None:
            return 0
        known = written(rows.join(held.select("id"), "id", "left_semi"), "known")
        if n := known.count():
            change.update("worktrees", known, "id")
        discard(known)
        return n

    n = changed(spark, store, do)
    discard(rows)
    return n


def set_status(spark: SparkSession, store: str, rows: DataFrame, now: str | None = None) -> int:
    """Gives worktrees (id) a status; those that it ends are resolved at ``at`` (now if not said), others keep their time.

    Of several rows of a worktree the one of the latest ``at`` counts, then
    that of the greatest status. Ids that are not stored are passed over.
    Returns how many worktrees were set; refuses unknown statuses.
    """
    shaped = _shaped(rows, "id long, status string, at string", {"at": now or _now()}).where("id is not null")
    _refuse(shaped, F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "have an unknown status")
    last = shaped.groupBy("id").agg(F.max(F.struct("at", "status")).alias("r")).select("id", "r.*")
    ended = F.when(F.col("status").isin(*FINAL), F.col("at"))
    return _update_known(spark, store, written(last.select("id", "status", ended.alias("resolved_at")).withColumn("resolved_s", _seconds("resolved_at")), "statuses"))


def set_variant(spark: SparkSession, store: str, rows: DataFrame) -> int:
    """Gives worktrees (id) ``ab_variant_label`` and ``ab_brief_metadata``, a JSON text, where not null; of several rows of one, the greatest of each."""
    shaped = _shaped(rows, "id long, ab_variant_label string, ab_brief_metadata string", {}).where("id is not null")
    return _update_known(spark, store, written(shaped.groupBy("id").agg(F.max("ab_variant_label").alias("ab_variant_label"), F.max("ab_brief_metadata").alias("ab_brief_metadata")), "variants"))


def put_results(spark: SparkSession, store: str, results: DataFrame) -> int:
    """Keeps each worktree's row of ``results`` (id and any columns, as the plan ``worktree_result`` gives them) as JSON in ``results_json``."""
    whole = results.where("id is not null").select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("results_json"))
    return _update_known(spark, store, written(whole.groupBy(F.col("id").cast("long").alias("id")).agg(F.max("results_json").alias("results_json")), "results"))


def add_calls(spark: SparkSession, store: str, rows: DataFrame) -> None:
    """Adds records of calls whose id is not stored yet; of several new ones of an id the earliest."""
    changed(spark, store, lambda change: change.insert("calls", rows, "id", "timestamp"))


def put_metrics(spark: SparkSession, store: str, sessions: DataFrame, turns: DataFrame) -> None:
    """Puts the measures of sessions and of their turns (both by ``session_id``) in place of what those sessions had, in one change."""

    def do(change: Change) -> None:
        change.replace("session_metrics", sessions, "session_id")
        change.replace("turn_metrics", turns, "session_id")

    changed(spark, store, do)
