"""SQL for DuckDB that states, apart from the plans and in other terms, what the main ones compute."""

from __future__ import annotations

#: Which session of calls each call is in, by counting the gaps before it.
_SESSIONS = """
g AS (SELECT *, lag(ts_s) OVER (PARTITION BY project ORDER BY ts_s, id) AS before FROM {calls} WHERE project IS NOT NULL),
s AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR ts_s - before >= %d) OVER (PARTITION BY project ORDER BY ts_s, id) AS ordinal FROM g)"""
#: Whole sessions as ordered lists, and what is read from them position by position.
_LISTS = (
    _SESSIONS % 86400
    + """,
l AS (SELECT project, ordinal, list({{'id': id, 'tools': CAST(tools_used AS VARCHAR[]), 'stop': stop_reason, 'usd': CAST(cost_estimate_usd AS DECIMAL(18, 6)), 'at': timestamp, 'variant': enrichment_variant, 'agent': agent_type}} ORDER BY ts_s, id) AS c FROM s GROUP BY project, ordinal),
e AS (SELECT *, list_filter(range(1, len(c) + 1), lambda i: list_has_any(c[i].tools, ['Edit', 'Write', 'NotebookEdit']))[1] AS first_edit FROM l),
k AS (SELECT *, list_filter(list_transform(c, lambda x: CASE WHEN list_has_any(x.tools, ['Edit', 'Write', 'NotebookEdit']) THEN 'e' WHEN list_contains(x.tools, 'Bash') THEN 'b' END), lambda x: x IS NOT NULL) AS marks FROM e),
m AS (SELECT project, ordinal, c[1].id AS first_call, CAST(len(c) AS BIGINT) AS turns, CAST(first_edit AS BIGINT) AS first_edit, CAST(coalesce(first_edit - 1, len(c)) AS BIGINT) AS exploration_turns,
  CAST(coalesce(list_sum(list_transform(c[1:coalesce(first_edit - 1, len(c))], lambda x: x.usd)), 0) AS DOUBLE) AS exploration_cost, CAST(list_sum(list_transform(c, lambda x: x.usd)) AS DOUBLE) AS total_cost,
  CAST(coalesce(list_sum(list_transform(c[1:coalesce(first_edit, len(c))], lambda x: len(list_intersect(x.tools, ['Read', 'Grep', 'Glob'])))), 0) AS BIGINT) AS reads_before_edit, CAST(len(list_filter(c, lambda x: x.stop = 'error')) AS BIGINT) AS errors_count,
  c[-1].stop AS last_stop, list_min(list_transform(c, lambda x: x.at)) AS started_at, list_max(list_transform(c, lambda x: x.at)) AS ended_at, list_max(list_transform(c, lambda x: x.variant)) AS variant, list_max(list_transform(c, lambda x: x.agent)) AS agent_type,
  CASE WHEN len(c) >= 31 THEN 'long' WHEN len(c) >= 10 THEN 'medium' ELSE 'short' END AS length_category, CASE WHEN len(c) < 3 THEN 'abandoned' WHEN c[-1].stop = 'end_turn' THEN 'completed' ELSE 'unknown' END AS outcome,
  CAST(greatest((length(array_to_string(marks, '')) - length(replace(array_to_string(marks, ''), 'eb', ''))) // 2 - 1, 0) AS BIGINT) AS correction_cycles FROM k)"""
)
_FILES = "SELECT DISTINCT session_id, target FROM {artifacts} WHERE artifact_type = ANY(['file_write', 'file_create']) AND NOT contains(target, '*')"
_PAIRS = f"SELECT x.target AS file_a, y.target AS file_b, count(DISTINCT session_id) AS co_sessions FROM ({_FILES}) x JOIN ({_FILES}) y USING (session_id) WHERE x.target < y.target GROUP BY ALL HAVING count(DISTINCT session_id) > 1"
#: Names of test files: a name that begins with test_, or parts that say so.
_TEST = "(starts_with({f}, 'test_') OR contains({f}, '/test_') OR contains({f}, '.test.') OR contains({f}, '.spec.') OR contains({f}, '/tests/') OR contains({f}, '/__tests__/'))"
_WRITES = "SELECT * FROM {artifacts} WHERE artifact_type = ANY(['file_write', 'file_create'])"
_ERRORS = "SELECT * FROM {artifacts} WHERE artifact_type = 'error' AND left(target, 1) NOT IN ('{{', '[')"
_CAUSES = f"SELECT left(e.target, 100) AS pattern, w.target AS path, count(DISTINCT e.id) AS n FROM ({_WRITES}) w JOIN ({_ERRORS}) e USING (session_id) WHERE abs(e.sequence - w.sequence) <= 10 GROUP BY ALL"
_DOLLARS = "CAST(15 * coalesce(token_usage_in, 0) + 75 * coalesce(token_usage_out, 0) + 1.5 * coalesce(cache_read_tokens, 0) + 18.75 * coalesce(cache_create_tokens, 0) AS DECIMAL(18, 2))"
_COSTS = f"SELECT session_id, CAST(sum(token_usage_in) AS BIGINT) AS tokens_in, CAST(sum(token_usage_out) AS BIGINT) AS tokens_out, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read, CAST(sum(cache_create_tokens) AS BIGINT) AS cache_create, CAST(sum({_DOLLARS}) AS DECIMAL(28, 2)) AS m_usd FROM {{messages}} GROUP BY session_id"
#: Millionths of dollars, exact, rounded to a number of digits.
_ROUNDED = "CAST(round(CAST({x} AS DECIMAL(30, 8)) * 0.000001, {digits}) AS DOUBLE)"


def _money(x: str, digits: int) -> str:
    return _ROUNDED.format(x=x, digits=digits)


def _mean(column: str, digits: int) -> str:
    """The mean of whole numbers, in exact decimals: half of the last digit is added and the rest cut."""
    return f"CASE WHEN count({column}) > 0 THEN CAST(CAST(sum({column}) AS HUGEINT) * {2 * 10**digits} + count({column}) AS HUGEINT) // (2 * count({column})) / {10**digits}.0E0 END"


_MICROS = "CAST(round({c} * 1000000) AS BIGINT)"
APART: dict[str, str] = {
    "session_costs": f"SELECT p.session_id, project, message_count, tokens_in, tokens_out, cache_read, cache_create, {_money('m_usd', 2)} AS estimated_cost FROM ({_COSTS}) p LEFT JOIN {{sessions}} USING (session_id) ORDER BY m_usd DESC, p.session_id LIMIT 10",
    "graph_session_nodes": f"SELECT s.session_id, project, message_count, tokens_in, tokens_out, cache_read, cache_create, {_money('coalesce(m_usd, 0)', 4)} AS cost, (date_diff('second', CAST(created_at AS TIMESTAMP), CAST(updated_at AS TIMESTAMP)) * 10 + 30) // 60 / 10.0E0 AS duration_minutes FROM {{sessions}} s LEFT JOIN ({_COSTS}) p USING (session_id)",
    "topics": "SELECT " + ", ".join(f"(SELECT count(DISTINCT session_id) FROM {{messages}} WHERE contains(lower(content), '{t.lower()}')) AS topic_{t.lower()}" for t in ("webhook", "deploy", "migration", "KYB", "KYC", "withdraw", "deposit", "balance", "wallet", "docker", "database", "test", "bug", "fix")),
    "danger_zones": f"SELECT w.target AS path, count(DISTINCT e.id) AS errors, count(DISTINCT w.id) AS writes, count(DISTINCT w.session_id) AS sessions, count(DISTINCT e.id) || ':' || count(DISTINCT w.id) AS ratio FROM ({_WRITES}) w LEFT JOIN ({_ERRORS}) e ON e.session_id = w.session_id AND abs(e.sequence - w.sequence) <= 10 WHERE NOT contains(w.target, '/plans/') AND NOT contains(w.target, '/node_modules/') GROUP BY w.target HAVING count(e.id) > 0 ORDER BY CAST(count(DISTINCT e.id) AS DOUBLE) / count(DISTINCT w.id) DESC, path LIMIT 5",
    "danger_all": f"SELECT w.target AS path, count(DISTINCT e.id) AS errors, count(DISTINCT w.id) AS writes, count(DISTINCT w.session_id) AS sessions FROM ({_WRITES}) w LEFT JOIN ({_ERRORS}) e ON e.session_id = w.session_id AND abs(e.sequence - w.sequence) <= 10 WHERE NOT contains(w.target, '/plans/') AND NOT contains(w.target, '/node_modules/') GROUP BY w.target HAVING count(e.id) > 0",
    "co_change": f"{_PAIRS} ORDER BY co_sessions DESC, file_a, file_b LIMIT 5",
    "graph_co_change": _PAIRS,
    "tested_by": f"SELECT CASE WHEN ta THEN file_b ELSE file_a END AS source, CASE WHEN ta THEN file_a ELSE file_b END AS test_file, co_sessions FROM (SELECT *, {_TEST.format(f='file_a')} AS ta, {_TEST.format(f='file_b')} AS tb FROM ({_PAIRS})) WHERE ta <> tb",
    "causes_error": f"SELECT pattern, path, n, CAST((2000000 * n + g) // (2 * g) AS DOUBLE) / 1.0E6 AS ratio FROM (SELECT c.*, greatest((SELECT count(*) FROM ({_WRITES}) v WHERE v.target = c.path), 1) AS g FROM ({_CAUSES}) c)",
    "danger_ratio": f"SELECT path, CAST((2000000 * n + g) // (2 * g) AS DOUBLE) / 1.0E6 AS danger_ratio FROM (SELECT path, CAST(sum(n) AS BIGINT) AS n, greatest((SELECT count(*) FROM ({_WRITES}) v WHERE v.target = path), 1) AS g FROM ({_CAUSES}) WHERE NOT contains(path, '*') GROUP BY path)",
    "read_loops": "SELECT session_id, target, count(*) AS reads FROM {artifacts} WHERE artifact_type = 'file_read' GROUP BY ALL HAVING count(*) >= 2",
    "first_messages_tools": "SELECT ifnull(tool_name, 'none') AS tool, count(*) AS n FROM {messages} WHERE sequence <= 9 GROUP BY ALL",
    "file_history": f"SELECT t.target, count(*) FILTER (WHERE artifact_type = 'file_read') AS reads, count(*) FILTER (WHERE artifact_type IN ('file_write', 'file_create')) AS writes, greatest(count(DISTINCT session_id) FILTER (WHERE artifact_type = 'file_read'), count(DISTINCT session_id) FILTER (WHERE artifact_type = 'file_write'), count(DISTINCT session_id) FILTER (WHERE artifact_type = 'file_create')) AS sessions, any_value(x.last_error) AS last_error, any_value(x.at) AS last_error_at FROM {{artifacts}} t LEFT JOIN (SELECT w.target, arg_max(left(e.target, 80), e.id) AS last_error, max(e.id) AS at FROM ({_WRITES}) w JOIN ({_ERRORS}) e USING (session_id) GROUP BY w.target) x ON x.target = t.target WHERE starts_with(artifact_type, 'file') GROUP BY t.target",
    "sessionize": f"WITH {_SESSIONS % 600} SELECT project, ordinal, min(id) AS first_call, count(*) AS turns, min(timestamp) AS started_at, max(timestamp) AS ended_at FROM s GROUP BY ALL",
    "session_metrics": f"WITH {_LISTS} SELECT * FROM m",
    "correction_cycles": f"WITH {_LISTS} SELECT project, ordinal, correction_cycles, CASE WHEN correction_cycles > 0 THEN outcome END AS loop_outcome FROM m",
    "length_category": f"WITH {_LISTS} SELECT length_category, outcome, count(*) AS n FROM m GROUP BY ALL",
    "turn_metrics": f"WITH {_LISTS} SELECT s.project, s.ordinal, row_number() OVER w AS turn, input_tokens, output_tokens, CAST(sum(CAST(cost_estimate_usd AS DECIMAL(18, 6))) OVER w AS DOUBLE) AS cumulative_cost, CASE WHEN cache_read_tokens + input_tokens > 0 THEN (20000 * cache_read_tokens + cache_read_tokens + input_tokens) // (2 * (cache_read_tokens + input_tokens)) / 10000.0E0 ELSE 0.0E0 END AS cache_hit_ratio, tools_used FROM s WINDOW w AS (PARTITION BY project, ordinal ORDER BY ts_s, id)",
    "variant_comparison": f"WITH {_LISTS} SELECT ifnull(variant, 'baseline') AS variant, count(*) AS sessions, {_mean('first_edit', 4)} AS first_edit, {_mean('exploration_turns', 4)} AS exploration_turns, {_mean(_MICROS.format(c='exploration_cost'), 0)} / 1000000.0E0 AS exploration_cost, {_mean('turns', 4)} AS turns, {_mean(_MICROS.format(c='total_cost'), 0)} / 1000000.0E0 AS cost, {_mean('reads_before_edit', 4)} AS reads, {_mean('errors_count', 4)} AS errors FROM m WHERE turns > 2 GROUP BY 1",
    "variant_by_length": f"WITH {_LISTS} SELECT ifnull(variant, 'baseline') AS variant, length_category, count(*) AS sessions, {_mean('turns', 4)} AS turns, {_mean(_MICROS.format(c='total_cost'), 0)} / 1000000.0E0 AS cost FROM m GROUP BY 1, 2",
    "worktree_result": "SELECT w.id, w.ab_variant_label, w.status, greatest(w.created_s, ifnull(w.resolved_s, w.created_s), ifnull(c.hi, w.created_s), ifnull(k.hi, w.created_s)) - least(w.created_s, ifnull(w.resolved_s, w.created_s), ifnull(c.lo, w.created_s), ifnull(k.lo, w.created_s)) AS duration_seconds, ifnull(c.n, 0) AS cycles, ifnull(k.n, 0) AS snapshot_files, ifnull(c.failed, 0) AS failures FROM {worktrees} w LEFT JOIN (SELECT worktree_id, min(created_s) AS lo, max(created_s) AS hi, count(*) AS n, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM {cycles} GROUP BY ALL) c ON c.worktree_id = w.id LEFT JOIN (SELECT worktree_id, min(created_s) AS lo, max(created_s) AS hi, count(DISTINCT file) AS n FROM {checkpoints} GROUP BY ALL) k ON k.worktree_id = w.id",
    "worktrees_by_status": "SELECT id, branch_name, task_description FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS place FROM {worktrees} WHERE status = 'failed') WHERE place <= 50",
    "correction_counts": "SELECT worktree_id, count(*) AS cycles, max(cycle_number) AS latest, arg_max(outcome, {{n: cycle_number, o: outcome}}) AS latest_outcome FROM {cycles} GROUP BY ALL",
    "worktree_with_cycles": "SELECT w.id, w.branch_name, w.status, c.cycles, k.id AS checkpoint_id, k.git_sha FROM {worktrees} w LEFT JOIN (SELECT worktree_id, string_agg(cycle_number || ':' || outcome, ',' ORDER BY cycle_number, outcome) AS cycles FROM {cycles} GROUP BY worktree_id) c ON c.worktree_id = w.id LEFT JOIN (SELECT * FROM {checkpoints} QUALIFY row_number() OVER (PARTITION BY worktree_id ORDER BY id DESC, git_sha DESC) = 1) k ON k.worktree_id = w.id",
    "last_session_summary": "SELECT s.project, s.session_id, s.message_count, count(DISTINCT a.target) FILTER (WHERE a.artifact_type IN ('file_write', 'file_create')) AS edited, coalesce(array_to_string(list_sort(list(DISTINCT a.target) FILTER (WHERE a.artifact_type IN ('file_write', 'file_create')))[1:3], ', '), '') AS files, arg_min(a.target, a.sequence) FILTER (WHERE a.artifact_type = 'command' AND NOT starts_with(a.target, 'cd') AND NOT starts_with(a.target, 'ls')) AS first_command, count(*) FILTER (WHERE a.artifact_type = 'command' AND NOT starts_with(a.target, 'cd') AND NOT starts_with(a.target, 'ls')) AS commands, count(*) FILTER (WHERE a.artifact_type = 'error') AS errors FROM (SELECT * FROM {sessions} QUALIFY row_number() OVER (PARTITION BY project ORDER BY updated_at DESC, session_id) = 1) s JOIN {artifacts} a USING (session_id) GROUP BY ALL UNION ALL SELECT s.project, s.session_id, s.message_count, NULL, NULL, NULL, NULL, NULL FROM (SELECT * FROM {sessions} QUALIFY row_number() OVER (PARTITION BY project ORDER BY updated_at DESC, session_id) = 1) s ANTI JOIN {artifacts} a USING (session_id)",
}
