"""Reports for a task at hand: similar history, corrections of a worktree, two sessions side by side, the monitor."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.api import History, bar, short_number
from tessella.operators import search


def task_terms(task: str, most: int = 6) -> list[str]:
    """The task's first words of three letters or digits and more."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9]{3,}", task.lower())))[:most]


def _any_term(docs: DataFrame, terms: list[str], *columns: str, limit: int) -> DataFrame:
    scored = search.bm25(docs, terms, *columns).groupBy("id").agg(F.sum("score").alias("score"))
    return scored.orderBy("score", "id").limit(limit).join(docs, "id").orderBy("score", "id")


def similar_history(history: History, task: str, limit: int = 5) -> dict[str, list[dict]]:
    """Worktrees, correction errors and assistant messages that share words with a task."""
    terms, t = task_terms(task), history.tables
    if not terms:
        return {"worktrees": [], "errors": [], "messages": []}
    worktrees = _any_term(t["worktrees"], terms, "task_description", "branch_name", limit=limit).select("id", "branch_name", "status", "task_description", "ab_variant_label")
    errors = _any_term(t["cycles"], terms, "trigger_error", limit=limit).select("worktree_id", "trigger_error", "outcome")
    said = _any_term(t["messages"].where("role = 'assistant'").select("id", "content", "session_id", "timestamp"), terms, "content", limit=limit)
    return {"worktrees": [r.asDict() for r in worktrees.collect()], "errors": [r.asDict() for r in errors.collect()], "messages": [r.asDict() for r in said.select("session_id", "timestamp", F.substring("content", 1, 200).alias("snippet")).collect()]}


def correction_brief(history: History, worktree: int) -> str:
    """What was tried in a worktree: its cycles in order, its latest checkpoint, and errors of others like its last one."""
    cycles = history.tables["cycles"].where(F.col("worktree_id") == worktree).orderBy("cycle_number", "id").collect()
    checkpoint = history.ask("latest_checkpoint").where(F.col("worktree_id") == worktree).collect()
    lines = [f"# Worktree {worktree}", "", *(f"- cycle {c['cycle_number']}: {c['trigger_error']} ({c['outcome']}, {c['duration_seconds']} s)" for c in cycles)]
    if checkpoint:
        lines += ["", f"Latest checkpoint: {checkpoint[0]['git_sha']}"]
    if cycles:
        others = history.tables["cycles"].where(F.col("worktree_id") != worktree)
        found = _any_term(others, task_terms(cycles[-1]["trigger_error"] or ""), "trigger_error", limit=3).collect() if task_terms(cycles[-1]["trigger_error"] or "") else []
        lines += ["", "Similar errors elsewhere:", *(f"- {r['trigger_error']} ({r['outcome']})" for r in found)] if found else []
    return "\n".join(lines)


def compared(history: History, first: str, second: str) -> DataFrame:
    """Tools of two sessions side by side: tool, n_first, n_second."""
    count = lambda s, n: history.tables["messages"].where((F.col("session_id") == s) & F.col("tool_name").isNotNull()).groupBy(F.col("tool_name").alias("tool")).agg(F.count("*").alias(n))
    return count(first, "n_first").join(count(second, "n_second"), "tool", "full_outer").na.fill(0).orderBy(F.desc(F.col("n_first") + F.col("n_second")), "tool")


def monitor(history: History) -> str:
    """Totals, roles and tools as text."""
    stats = history.ask("stats").first()
    roles = history.ask("role_breakdown").orderBy(F.desc("n")).collect()
    n = sum(r["n"] for r in roles) or 1
    lines = [f"{short_number(stats['total_sessions'])} sessions, {short_number(stats['total_messages'])} messages, {short_number(stats['tokens_in'])} tokens in, {short_number(stats['tokens_out'])} out"]
    lines += [f"{r['role']:<10} {bar(r['n'] / n)} {r['n']}" for r in roles]
    lines += [f"{r['tool']:<10} {r['n']}" for r in history.ask("tool_usage").collect()]
    return "\n".join(lines)
