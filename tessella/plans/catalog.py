"""The analytic plans, as SQL over the engine's tables.

A plan names its tables in braces (literal braces are doubled) and keeps to SQL
that Spark and DuckDB read alike; ``to_duckdb`` spells the few functions that
differ. Sums of integers are cast to BIGINT, orders that cut a result are total,
and nulls are placed explicitly. Money and quotients that are rounded are
computed in whole numbers (of 1e-8 dollars), so that no result depends on the
order of a sum. Names of ``PARAMS`` in braces are arguments with defaults.
"""

from __future__ import annotations

from tessella.functions.text import BOILERPLATE

#: Dollars per million tokens are 15, 75, 1.5 and 18.75 (fixed values); here in units of 1e-8 dollars a token.
UNITS = """
(coalesce({p}token_usage_in, 0) * 1500 + coalesce({p}token_usage_out, 0) * 7500 + coalesce({p}cache_read_tokens,
  0) * 150 + coalesce({p}cache_create_tokens, 0) * 1875)"""
#: Arguments of plans and their defaults; of filters by name, an empty one is none.
PARAMS: dict[str, int | str] = {
    "min_messages": 5, "most_reads": 5, "sort": "recent", "project": "-Users-dev-code-app1", "kind": "file_write", "name": "code-app3", "prefix": "e1", "role": "assistant",
    "session": "", "target": "", "of_project": "", "from_s": 1704500000, "to_s": 1705500000, "status": "failed", "now_s": 1800000000,
}


def units(prefix: str = "") -> str:
    """A row's cost in units."""
    return UNITS.replace("{p}", prefix)


def quotient(a: str, b: str, digits: int) -> str:
    """a / b of whole numbers, a not negative and b positive, rounded half up."""
    return f"(CAST((2 * ({a}) * {10**digits} + ({b})) DIV (2 * ({b})) AS DOUBLE) / {10**digits}.0E0)"


def mean(column: str, digits: int) -> str:
    """The mean of a column of whole numbers; null if it has none."""
    return f"CASE WHEN count({column}) > 0 THEN {quotient(f'CAST(sum({column}) AS BIGINT)', f'count({column})', digits)} END"


def dollars(units: str, digits: int) -> str:
    """Units as dollars, rounded half away from zero."""
    scale = 10 ** (8 - digits)
    return f"(sign({units}) * (CAST((abs({units}) + {scale // 2}) DIV {scale} AS DOUBLE) / {10**digits}.0E0))"


def quoted(value: int | str) -> str:
    """A literal."""
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def micro(column: str) -> str:
    """Dollars that have six digits, as a whole number of millionths."""
    return f"CAST(round({column} * 1.0E6) AS BIGINT)"


def total(column: str) -> str:
    return f"CAST(coalesce(sum({column}), 0) AS BIGINT)"


WRITES = "('file_write', 'file_create')"
#: Paths that do not count as files at risk, and texts that are no error messages (fixed values).
NO_RISK = "w.target NOT LIKE '%/plans/%' AND w.target NOT LIKE '%/node_modules/%'"
REAL_ERROR = "{a}target NOT LIKE '{{%' AND {a}target NOT LIKE '[%'"
#: Words whose sessions are counted, and that make a message's concepts (fixed values).
TOPICS = ("webhook", "deploy", "migration", "KYB", "KYC", "withdraw", "deposit", "balance", "wallet", "docker", "database", "test", "bug", "fix")
CONCEPTS = (
    "authentication", "authorization", "database", "deployment", "docker", "testing", "api", "webhook", "migration", "caching", "logging", "monitoring", "security", "performance", "refactoring", "ci/cd",
    "frontend", "backend", "infrastructure", "configuration",
)
GAP_SECONDS = 600


def real_error(alias: str = "") -> str:
    return REAL_ERROR.replace("{a}", alias)


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {quotient(a, b, 6)} ELSE 0.0E0 END"


TOKENS = f"""
{total('m.token_usage_in')} AS tokens_in, {total('m.token_usage_out')} AS tokens_out, {total('m.cache_read_tokens')} AS cache_read,
  {total('m.cache_create_tokens')} AS cache_create"""
PER_SESSION = f"""
SELECT m.session_id, count(*) AS n, {TOKENS}, count(m.tool_name) AS tool_calls, CAST(sum({units('m.')}) AS BIGINT) AS cost_units
FROM {{messages}} m
GROUP BY m.session_id"""
TOOL_COUNTS = (
    "count(*) AS messages, count(CASE WHEN m.tool_name IN ('Read', 'Glob', 'Grep') THEN 1 END) AS exploration, count(CASE WHEN m.tool_name IN ('Edit', 'Write', 'NotebookEdit') THEN 1 END) AS mutation, "
    "count(CASE WHEN m.tool_name = 'Bash' THEN 1 END) AS execution, count(CASE WHEN m.content ILIKE '%error%' THEN 1 END) AS errors, count(CASE WHEN m.tool_name IS NOT NULL THEN 1 END) AS tool_calls"
)
RATIOS = f"""
{ratio('exploration', 'tool_calls')} AS exploration_ratio, {ratio('mutation', 'tool_calls')} AS mutation_ratio,
  {ratio('execution', 'tool_calls')} AS execution_ratio, {ratio('errors', 'messages')} AS error_ratio"""

#: Sessions of calls: a new one where the project changes or GAP seconds or more have passed.
#: Calls are ordered inside ranges of RANGE seconds, so a project of very many calls is many tasks; what a range needs of
#: those before it is their last time and how many sessions began in them, a row for each range.
SESSIONISED = """
WITH d AS (SELECT *, CAST(floor(ts_s / RANGE.0E0) AS BIGINT) AS part FROM {calls} WHERE project IS NOT NULL),
e AS (SELECT project, part, max(ts_s) AS last_s FROM d GROUP BY project, part),
p AS (SELECT project, part, lag(last_s) OVER (PARTITION BY project ORDER BY part) AS before_s FROM e),
b AS (SELECT d.*, CASE WHEN d.ts_s - coalesce(lag(d.ts_s) OVER (PARTITION BY d.project, d.part ORDER BY d.ts_s, d.id), p.before_s) < GAP THEN 0 ELSE 1 END AS begins FROM d JOIN p ON p.project = d.project AND p.part = d.part),
n AS (SELECT project, part, sum(begins) AS begun FROM b GROUP BY project, part),
s AS (SELECT project, part, sum(begun) OVER (PARTITION BY project ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - begun AS sooner FROM n)
SELECT b.*, s.sooner + sum(b.begins) OVER (PARTITION BY b.project, b.part ORDER BY b.ts_s, b.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ordinal
FROM b JOIN s ON s.project = b.project AND s.part = b.part""".replace("RANGE", "21600")
TURNS = f"""
SELECT s.*, row_number() OVER (PARTITION BY project, ordinal ORDER BY ts_s, id) AS turn, count(*) OVER (PARTITION BY project, ordinal) AS turns,
  CASE WHEN tools_used LIKE '%"Edit"%' OR tools_used LIKE '%"Write"%' OR tools_used LIKE '%"NotebookEdit"%' THEN 1 ELSE 0 END AS is_edit,
  CASE WHEN tools_used LIKE '%"Read"%' THEN 1 ELSE 0 END + CASE WHEN tools_used LIKE '%"Grep"%' THEN 1 ELSE 0 END + CASE WHEN tools_used LIKE '%"Glob"%' THEN 1 ELSE 0 END AS reads,
  CASE WHEN tools_used LIKE '%"Bash"%' THEN 1 ELSE 0 END AS is_bash, {micro('cost_estimate_usd')} AS micros
FROM ({SESSIONISED}) s"""
#: Turns with their session's first edit and, where they edit (1) or run a command (0), which of the two came last before.
MARKED = f"""
SELECT t.*, min(CASE WHEN is_edit = 1 THEN turn END) OVER (PARTITION BY project, ordinal) AS first_edit,
  last_value(mark) IGNORE NULLS OVER (PARTITION BY project, ordinal ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark_before
FROM (SELECT x.*, CASE WHEN is_edit = 1 THEN 1 WHEN is_bash = 1 THEN 0 END AS mark FROM ({TURNS}) x) t"""
METRICS = f"""
SELECT m.*, exploration_micros / 1.0E6 AS exploration_cost, total_micros / 1.0E6 AS total_cost, CASE WHEN turns < 10 THEN 'short' WHEN turns <= 30 THEN 'medium' ELSE 'long' END AS length_category,
  CASE WHEN turns >= 3 AND last_stop = 'end_turn' THEN 'completed' WHEN turns <= 2 THEN 'abandoned' ELSE 'unknown' END AS outcome, greatest(transitions - 1, 0) AS correction_cycles
FROM (
  SELECT project, ordinal, min(id) AS first_call, CAST(max(turns) AS BIGINT) AS turns, max(first_edit) AS first_edit, count(CASE WHEN first_edit IS NULL OR turn < first_edit THEN 1 END) AS exploration_turns,
    CAST(sum(CASE WHEN first_edit IS NULL OR turn < first_edit THEN micros ELSE 0 END) AS BIGINT) AS exploration_micros, CAST(sum(micros) AS BIGINT) AS total_micros,
    CAST(sum(CASE WHEN first_edit IS NULL OR turn <= first_edit THEN reads ELSE 0 END) AS BIGINT) AS reads_before_edit, count(CASE WHEN stop_reason = 'error' THEN 1 END) AS errors_count,
    max(CASE WHEN turn = turns THEN stop_reason END) AS last_stop, min(timestamp) AS started_at, max(timestamp) AS ended_at, max(enrichment_variant) AS variant, max(agent_type) AS agent_type,
    count(CASE WHEN mark = 0 AND mark_before = 1 THEN 1 END) AS transitions
  FROM ({MARKED}) t GROUP BY project, ordinal) m"""
METRIC_COLUMNS = """
project, ordinal, first_call, turns, first_edit, exploration_turns, exploration_cost, total_cost, reads_before_edit, errors_count,
  last_stop, started_at, ended_at, variant, agent_type, length_category, outcome, correction_cycles"""
KEY_FILES = """
SELECT a.target AS path, count(*) AS n, count(DISTINCT a.session_id) AS sessions
FROM {artifacts} a
WHERE {where}
GROUP BY a.target
ORDER BY n DESC, path LIMIT {limit}"""


def key_files(where: str, limit: int) -> str:
    return KEY_FILES.replace("{where}", where).replace("{limit}", str(limit))


KEY_READ = key_files("a.artifact_type = 'file_read' AND a.target NOT LIKE '%*%'", 10)
KEY_MODIFIED = key_files(f"a.artifact_type IN {WRITES}", 10)
#: Errors, each in the band of 16 places that it is in and the two beside it, so that a hot session's rows meet by band and not all in one task.
BANDED_ERRORS = f"""
SELECT e.id, e.session_id, e.target, e.sequence, explode(array(e.sequence DIV 16 - 1, e.sequence DIV 16, e.sequence DIV 16 + 1)) AS band
FROM {{artifacts}} e
WHERE e.artifact_type = 'error' AND {real_error('e.')}"""
NEAR = "e.session_id = w.session_id AND e.band = w.sequence DIV 16 AND e.sequence BETWEEN w.sequence - 10 AND w.sequence + 10"
DANGER = f"""
SELECT w.target AS path, count(DISTINCT w.id) AS writes, count(DISTINCT e.id) AS errors, count(DISTINCT w.session_id) AS sessions
FROM {{artifacts}} w LEFT JOIN ({BANDED_ERRORS}) e ON {NEAR}
WHERE w.artifact_type IN {WRITES} AND {NO_RISK} GROUP BY w.target HAVING count(DISTINCT e.id) > 0"""
TOUCHED = f"SELECT DISTINCT session_id, target FROM {{artifacts}} WHERE artifact_type IN {WRITES} AND target NOT LIKE '%*%'"
#: Files that are touched in two sessions or more: no other can be in a pair of two sessions. A session's files are dealt into
#: blocks of about 256, and each file meets those of one other block in a task; of most sessions there is one block.
PAIRABLE = f"""
SELECT t.session_id, t.target, CAST(ceil(count(*) OVER (PARTITION BY t.session_id) / 256.0E0) AS INT) AS blocks
FROM ({TOUCHED}) t LEFT SEMI JOIN (SELECT target FROM ({TOUCHED}) u GROUP BY target HAVING count(*) >= 2) v ON v.target = t.target"""
DEALT = f"SELECT session_id, target, CAST(pmod(xxhash64(target), blocks) AS INT) AS own, explode(sequence(0, blocks - 1)) AS other FROM ({PAIRABLE}) q"
CO_CHANGE = f"""
SELECT a.target AS file_a, b.target AS file_b, count(*) AS co_sessions
FROM ({DEALT}) a
JOIN ({DEALT}) b ON a.session_id = b.session_id AND a.own = b.other AND a.other = b.own AND a.target < b.target
GROUP BY a.target, b.target HAVING count(*) >= 2"""
CAUSES = f"""
SELECT substr(e.target, 1, 100) AS pattern, w.target AS path, count(DISTINCT e.id) AS n FROM {{artifacts}} w JOIN ({BANDED_ERRORS}) e ON {NEAR}
WHERE w.artifact_type IN {WRITES} GROUP BY substr(e.target, 1, 100), w.target"""
FILE_NODES = f"""
SELECT target AS path, count(CASE WHEN artifact_type = 'file_read' THEN 1 END) AS reads, count(CASE WHEN artifact_type IN {WRITES}
  THEN 1 END) AS writes, count(DISTINCT session_id) AS sessions
FROM {{artifacts}}
WHERE artifact_type IN ('file_read', 'file_write', 'file_create') AND target NOT LIKE '%*%'
GROUP BY target"""
IS_TEST = "(^|/)test_|[.]test[.]|[.]spec[.]|/tests/|/__tests__/"
FIRST_USER = """
SELECT session_id, min(sequence) AS sequence
FROM {messages}
WHERE role = 'user' AND content IS NOT NULL AND length(trim(content)) > 0
GROUP BY session_id"""
#: The first message of a user that is not boilerplate.
FIRST_MEANT = FIRST_USER.replace("GROUP BY", "  AND " + " AND ".join(f"NOT lower(trim(content)) LIKE {quoted(p + '%')}" for p in BOILERPLATE) + " AND substr(trim(content), 1, 1) NOT IN ('{{', '[')\nGROUP BY")
RECENT = """
SELECT *
FROM (SELECT s.*, row_number() OVER (PARTITION BY project
ORDER BY updated_at DESC, session_id) AS recency
FROM {sessions} s) r
WHERE recency <= 3"""
ARTIFACT_COUNTS = (
    "count(CASE WHEN artifact_type = 'file_read' THEN 1 END) AS reads, count(CASE WHEN artifact_type = 'file_write' THEN 1 END) AS writes, count(CASE WHEN artifact_type = 'file_create' THEN 1 END) AS creates, "
    "count(CASE WHEN artifact_type = 'command' THEN 1 END) AS commands, count(CASE WHEN artifact_type = 'api_call' THEN 1 END) AS api_calls, count(CASE WHEN artifact_type = 'error' THEN 1 END) AS errors"
)


def lower(metric: str) -> str:
    """Which of a and b has less of a metric, and by how many percent b differs (null where a has none)."""
    return f"CASE WHEN a.{metric} < b.{metric} THEN 'a' WHEN a.{metric} > b.{metric} THEN 'b' ELSE 'tie' END AS {metric}_winner, CASE WHEN a.{metric} != 0 THEN round((b.{metric} - a.{metric}) * 100.0E0 / a.{metric}, 2) END AS {metric}_delta_pct"


WORKTREE_RESULT = f"""
SELECT w.id, w.ab_variant_label, w.status, t.last_s - t.first_s AS duration_seconds, coalesce(c.cycles, 0) AS cycles, coalesce(k.files, 0) AS snapshot_files, coalesce(c.failures, 0) AS failures
FROM {{worktrees}} w JOIN (SELECT id, min(s) AS first_s, max(s) AS last_s FROM (SELECT id, created_s AS s FROM {{worktrees}} UNION ALL SELECT id, resolved_s FROM {{worktrees}} UNION ALL SELECT worktree_id, created_s FROM {{cycles}} UNION ALL SELECT worktree_id, created_s FROM {{checkpoints}}) u GROUP BY id) t ON t.id = w.id
LEFT JOIN (SELECT worktree_id, count(*) AS cycles, count(CASE WHEN outcome = 'failed' THEN 1 END) AS failures FROM {{cycles}} GROUP BY worktree_id) c ON c.worktree_id = w.id
LEFT JOIN (SELECT worktree_id, count(DISTINCT file) AS files FROM {{checkpoints}} GROUP BY worktree_id) k ON k.worktree_id = w.id"""

#: Who wins an experiment: the arm that alone passed, or else the one that is faster by over a tenth.
OUTCOME = (
    "CASE WHEN enriched_status != baseline_status AND enriched_status = 'passed' THEN 'enriched_wins' WHEN enriched_status != baseline_status AND baseline_status = 'passed' THEN 'baseline_wins' "
    "WHEN enriched_status != 'passed' THEN 'inconclusive' WHEN enriched_duration * 10 < baseline_duration * 9 THEN 'enriched_wins' WHEN enriched_duration * 10 > baseline_duration * 11 THEN 'baseline_wins' ELSE 'tie' END"
)

PLANS: dict[str, str] = {
    # totals, costs and activity
    "stats": f"SELECT (SELECT count(*) FROM {{sessions}}) AS total_sessions, count(*) AS total_messages, {TOKENS} FROM {{messages}} m",
    "session_count": "SELECT project, count(*) AS sessions FROM {sessions} GROUP BY project",
    "session_costs": f"""
SELECT p.session_id, s.project, s.message_count, p.tokens_in, p.tokens_out, p.cache_read, p.cache_create, {dollars('p.cost_units', 2)}
  AS estimated_cost
FROM ({PER_SESSION}) p
LEFT JOIN {{sessions}} s ON s.session_id = p.session_id
ORDER BY p.cost_units DESC, p.session_id LIMIT 10""",
    "tool_usage": """
SELECT tool_name AS tool, count(*) AS n
FROM {messages}
WHERE tool_name IS NOT NULL AND tool_name != ''
GROUP BY tool_name
ORDER BY n DESC, tool LIMIT 15""",
    "role_breakdown": "SELECT role, count(*) AS n FROM {messages} GROUP BY role",
    "projects": f"""
SELECT project, count(*) AS sessions, {total('message_count')} AS messages
FROM {{sessions}}
WHERE project IS NOT NULL
GROUP BY project
ORDER BY sessions DESC, project LIMIT 10""",
    "cache_efficiency": f"""
SELECT total_input, cache_read, cache_create, tokens_in, tokens_out, CASE WHEN total_input > 0 THEN {quotient('cache_read * 100', 'total_input', 1)} ELSE 0.0E0 END AS cache_read_pct, {dollars('actual', 2)} AS cost_actual,
  {dollars('uncached', 2)} AS cost_without_cache, {dollars('(uncached - actual)', 2)} AS savings, CASE WHEN uncached > 0 THEN round((1 - CAST(actual AS DOUBLE) / uncached) * 100, 0) ELSE 0.0E0 END AS savings_pct
FROM (SELECT *, tokens_in * 1500 + cache_read * 150 + cache_create * 1875 + tokens_out * 7500 AS actual, total_input * 1500 + tokens_out * 7500 AS uncached
  FROM (SELECT *, tokens_in + cache_read + cache_create AS total_input FROM (SELECT {TOKENS} FROM {{messages}} m) a) b) c""",
    "hourly_activity": """
SELECT hour, count(*) AS n
FROM (SELECT TRY_CAST(substr(split_part(created_at, 'T', 2), 1, 2) AS INT) AS hour
FROM {sessions}) h
WHERE hour IS NOT NULL
GROUP BY hour""",
    "error_sessions": """
SELECT m.session_id, s.project, count(*) AS error_messages, s.message_count, round(count(*) * 100.0E0 / s.message_count, 0) AS error_pct
FROM {messages} m
JOIN {sessions} s ON s.session_id = m.session_id
WHERE (m.content ILIKE '%error%' OR m.content ILIKE '%fail%') AND m.role = 'assistant'
GROUP BY m.session_id, s.project, s.message_count
ORDER BY error_messages DESC, m.session_id LIMIT 10""",
    "expensive_per_message": f"""
SELECT p.session_id, s.project, s.message_count, {dollars('p.cost_units', 2)} AS total_cost,
  {quotient('p.cost_units', '1000 * s.message_count', 0)} / 1.0E5 AS cost_per_message
FROM ({PER_SESSION}) p
JOIN {{sessions}} s ON s.session_id = p.session_id
WHERE s.message_count > 20
ORDER BY CAST(p.cost_units AS DOUBLE) / s.message_count DESC, p.session_id LIMIT 10""",
    "topics": "SELECT " + ", ".join(f"CAST(coalesce(sum(topic_{t.lower()}), 0) AS BIGINT) AS topic_{t.lower()}" for t in TOPICS) + " FROM (SELECT session_id, " + ", ".join(f"max(CASE WHEN content ILIKE '%{t}%' THEN 1 ELSE 0 END) AS topic_{t.lower()}" for t in TOPICS) + " FROM {messages} GROUP BY session_id) s",
    "project_stats": f"""
SELECT c.*, {RATIOS}
FROM (SELECT s.project, count(DISTINCT m.session_id) AS sessions, {TOOL_COUNTS}, {TOKENS}
FROM {{messages}} m
JOIN {{sessions}} s ON s.session_id = m.session_id
GROUP BY s.project) c""",
    "session_stats": f"SELECT c.*, {RATIOS} FROM (SELECT m.session_id, {TOOL_COUNTS}, {TOKENS} FROM {{messages}} m GROUP BY m.session_id) c",
    "top_tools_per_project": """
SELECT project, tool, n, rank
FROM (SELECT project, tool, n, row_number() OVER (PARTITION BY project
ORDER BY n DESC, tool) AS rank
FROM (SELECT s.project, m.tool_name AS tool, count(*) AS n
FROM {messages} m
JOIN {sessions} s ON s.session_id = m.session_id
WHERE m.tool_name IS NOT NULL
GROUP BY s.project, m.tool_name) t) r
WHERE rank <= 5""",
    "project_overview": f"""
SELECT s.project, count(*) AS sessions, {total('s.message_count')} AS messages, min(s.created_at) AS first_session, max(s.updated_at)
  AS last_session, {total('p.tokens_in')} AS tokens_in, {total('p.tokens_out')} AS tokens_out,
  {dollars('(CAST(coalesce(sum(p.tokens_in), 0) AS BIGINT) * 1500 + CAST(coalesce(sum(p.tokens_out), 0) AS BIGINT) * 7500)', 6)}
  AS cost_estimate
FROM {{sessions}} s
LEFT JOIN ({PER_SESSION}) p ON p.session_id = s.session_id
GROUP BY s.project""",
    "cost_profile": f"""
SELECT project, CAST(floor(exploration_ratio * 100) AS BIGINT) AS exploration_pct, CAST(floor(mutation_ratio * 100) AS BIGINT)
  AS mutation_pct, CAST(floor(execution_ratio * 100) AS BIGINT) AS execution_pct, floor(exploration_ratio * 100) > 30 AS advise_index
FROM (SELECT c.*, {RATIOS}
FROM (SELECT s.project, {TOOL_COUNTS}
FROM {{messages}} m
JOIN {{sessions}} s ON s.session_id = m.session_id
GROUP BY s.project) c) d""",
    "list_sessions": f"""
SELECT s.session_id, s.project, s.message_count, s.created_at, s.updated_at, coalesce(p.tokens_in, 0) AS tokens_in, coalesce(p.tokens_out,
  0) AS tokens_out, coalesce(p.tool_calls, 0) AS tool_calls
FROM {{sessions}} s
LEFT JOIN ({PER_SESSION}) p ON p.session_id = s.session_id
WHERE s.message_count > {{min_messages}} AND ({{of_project}} = '' OR s.project = {{of_project}})
ORDER BY CASE WHEN {{sort}} = 'messages' THEN s.message_count WHEN {{sort}} = 'tokens' THEN coalesce(p.tokens_in,
  0) + coalesce(p.tokens_out, 0) ELSE 0 END DESC, s.updated_at DESC NULLS LAST, s.session_id LIMIT 50""",
    "session_by_prefix": """
SELECT session_id, project, updated_at
FROM {sessions}
WHERE session_id LIKE {prefix} || '%'
ORDER BY updated_at DESC NULLS LAST, session_id LIMIT 1""",
    "session_monitor": """
SELECT session_id, count(*) AS messages, count(CASE WHEN tool_name IN ('Read', 'Glob', 'Grep') THEN 1 END) AS reads, count(CASE
  WHEN tool_name IN ('Edit', 'Write') THEN 1 END) AS edits, count(CASE WHEN tool_name = 'Bash' THEN 1 END) AS commands
FROM {messages}
GROUP BY session_id
ORDER BY messages DESC, session_id LIMIT 20""",
    "default_project": """
SELECT project
FROM (SELECT project, count(*) AS n
FROM {sessions}
WHERE project IS NOT NULL
GROUP BY project) p
ORDER BY n DESC, project LIMIT 1""",
    "export_events": """
SELECT m.session_id, s.project, m.sequence, m.role, substr(m.content, 1, 500) AS content, m.tool_name, m.timestamp
FROM {messages} m
LEFT JOIN {sessions} s ON s.session_id = m.session_id""",
    "export_sessions": f"""
SELECT s.session_id, s.project, s.message_count, s.created_at, s.updated_at, p.tokens_in, p.tokens_out
FROM {{sessions}} s
LEFT JOIN ({PER_SESSION}) p ON p.session_id = s.session_id""",
    "resolve_project": """
SELECT project
FROM (SELECT project, count(*) AS n
FROM {sessions}
WHERE project = {name} OR project LIKE '%-' || {name} OR project = replace({name}, '.', '-') OR project LIKE '%-' || replace({name}, '.',
  '-')
GROUP BY project) p
ORDER BY n DESC, project LIMIT 1""",
    # artifacts
    "extract_artifacts": "SELECT id, session_id, artifact_type, target, tool_name, sequence FROM {artifacts}",
    "artifacts_filter": """
SELECT a.session_id, a.artifact_type, a.target, a.sequence
FROM {artifacts} a
JOIN {sessions} s ON s.session_id = a.session_id
WHERE ({project} = '' OR s.project = {project}) AND ({kind} = '' OR a.artifact_type = {kind}) AND ({session} = '' OR a.session_id = {session}) AND ({target} = '' OR a.target = {target})
ORDER BY a.id DESC LIMIT 100""",
    "key_files_read": KEY_READ,
    "key_files_modified": KEY_MODIFIED,
    "most_read": key_files("a.artifact_type = 'file_read'", 8),
    "read_only_files": f"""
SELECT r.path
FROM ({key_files(chr(39).join(['a.artifact_type = ', 'file_read', '']), 30)}) r
LEFT ANTI JOIN ({key_files(f'a.artifact_type IN {WRITES}', 30)}) w ON w.path = r.path""",
    "common_errors": f"""
SELECT substr(target, 1, 100) AS error_text, count(*) AS occurrences, count(DISTINCT session_id) AS sessions
FROM {{artifacts}}
WHERE artifact_type = 'error' AND {real_error()}
GROUP BY substr(target, 1, 100)
ORDER BY occurrences DESC, error_text LIMIT 10""",
    "known_errors": f"""
SELECT substr(target, 1, 120) AS error_text, count(*) AS occurrences
FROM {{artifacts}}
WHERE artifact_type = 'error' AND {real_error()}
GROUP BY substr(target, 1, 120)
HAVING count(*) >= 2
ORDER BY occurrences DESC, error_text LIMIT 3""",
    "danger_zones": f"""
SELECT path, errors, writes, sessions, errors || ':' || greatest(writes, 1) AS ratio
FROM ({DANGER}) d
ORDER BY CAST(errors AS DOUBLE) / greatest(writes, 1) DESC, path LIMIT 5""",
    "danger_all": f"SELECT path, errors, writes, sessions FROM ({DANGER}) d",
    "co_change": f"SELECT file_a, file_b, co_sessions FROM ({CO_CHANGE}) c WHERE co_sessions >= 2 ORDER BY co_sessions DESC, file_a, file_b LIMIT 5",
    "artifact_summary": f"SELECT session_id, {ARTIFACT_COUNTS} FROM {{artifacts}} GROUP BY session_id",
    "top_files": """
SELECT session_id, target, n, rank
FROM (SELECT session_id, target, n, row_number() OVER (PARTITION BY session_id
ORDER BY n DESC, target) AS rank
FROM (SELECT session_id, target, count(*) AS n
FROM {artifacts}
WHERE artifact_type LIKE 'file%'
GROUP BY session_id, target) t) r
WHERE rank <= 10""",
    "top_commands": """
SELECT session_id, target, n, rank
FROM (SELECT session_id, target, n, row_number() OVER (PARTITION BY session_id
ORDER BY n DESC, target) AS rank
FROM (SELECT session_id, target, count(*) AS n
FROM {artifacts}
WHERE artifact_type = 'command'
GROUP BY session_id, target) t) r
WHERE rank <= 10""",
    "file_history": f"""
SELECT f.target, reads, writes, sessions, e.error_text AS last_error, e.at AS last_error_at
FROM (SELECT target, CAST(sum(CASE WHEN artifact_type = 'file_read' THEN n ELSE 0 END) AS BIGINT) AS reads, CAST(sum(CASE
  WHEN artifact_type IN {WRITES} THEN n ELSE 0 END) AS BIGINT) AS writes, max(s) AS sessions
FROM (SELECT target, artifact_type, count(*) AS n, count(DISTINCT session_id) AS s
FROM {{artifacts}}
WHERE artifact_type LIKE 'file%'
GROUP BY target, artifact_type) t
GROUP BY target) f
LEFT JOIN (SELECT w.target, max_by(substr(x.target, 1, 80), x.id) AS error_text, max(x.id) AS at
FROM (SELECT DISTINCT session_id, target
FROM {{artifacts}}
WHERE artifact_type IN {WRITES}) w
JOIN (SELECT session_id, max_by(target, id) AS target, max(id) AS id
FROM {{artifacts}}
WHERE artifact_type = 'error' AND {real_error()}
GROUP BY session_id) x ON x.session_id = w.session_id
GROUP BY w.target) e ON e.target = f.target""",
    "ab_artifact_metrics": f"""
SELECT session_id, count(*) AS artifacts, count(DISTINCT CASE WHEN artifact_type LIKE 'file%' THEN target END) AS files_touched, count(CASE
  WHEN artifact_type = 'command' THEN 1 END) AS commands, count(CASE WHEN artifact_type = 'error' THEN 1 END) AS errors
FROM {{artifacts}}
GROUP BY session_id""",
    "reread_waste": """
SELECT s.project, CAST(sum(r.n - 1) AS BIGINT) AS redundant_reads, count(*) AS targets
FROM (SELECT session_id, target, count(*) AS n
FROM {artifacts}
WHERE artifact_type = 'file_read'
GROUP BY session_id, target) r
JOIN {sessions} s ON s.session_id = r.session_id
WHERE r.n > 1
GROUP BY s.project""",
    "brief_preemption": f"""
SELECT CAST(sum(n - 1) AS BIGINT) AS redundant, CAST(sum(CASE WHEN k.path IS NOT NULL THEN n - 1 ELSE 0 END) AS BIGINT) AS preempted
FROM (SELECT session_id, target, count(*) AS n
FROM {{artifacts}}
WHERE artifact_type = 'file_read'
GROUP BY session_id, target
HAVING count(*) > 1) r
LEFT JOIN (SELECT path
FROM ({KEY_READ}) a
UNION SELECT path
FROM ({KEY_MODIFIED}) b) k ON k.path = r.target""",
    "artifact_completeness": f"""
SELECT count(*) AS tool_messages, count(a.id) AS with_artifact, {quotient('count(a.id) * 100', 'count(*)', 2)} AS pct
FROM {{messages}} m
LEFT JOIN {{artifacts}} a ON a.id = m.id
WHERE m.tool_name IS NOT NULL""",
    "unparsed_tools": """
SELECT m.id, m.session_id, m.tool_name
FROM {messages} m
LEFT ANTI JOIN {artifacts} a ON a.id = m.id
WHERE m.role = 'assistant' AND (m.tool_name IS NOT NULL OR m.content ILIKE '%error%')""",
    "project_productivity": f"""
SELECT s.project, count(*) AS total, count(CASE WHEN a.artifact_type IN {WRITES} THEN 1 END) AS writes,
  {quotient(f'count(CASE WHEN a.artifact_type IN {WRITES} THEN 1 END) * 100', 'count(*)', 2)} AS write_pct,
  {quotient('count(CASE WHEN a.artifact_type = ' + quoted('error') + ' THEN 1 END) * 100', 'count(*)', 2)} AS error_pct
FROM {{artifacts}} a
JOIN {{sessions}} s ON s.session_id = a.session_id
GROUP BY s.project
HAVING count(*) > 50""",
    "edit_churn": f"""
SELECT session_id, target, count(*) AS edits
FROM {{artifacts}}
WHERE artifact_type IN {WRITES}
GROUP BY session_id, target
HAVING count(*) >= 3""",
    "read_loops": """
SELECT session_id, target, count(*) AS reads
FROM {artifacts}
WHERE artifact_type = 'file_read'
GROUP BY session_id, target
HAVING count(*) > {most_reads}""",
    "complexity_magnets": f"""
SELECT w.target, count(*) AS sessions, CAST(sum(coalesce(e.n, 0)) AS BIGINT) AS errors
FROM (SELECT DISTINCT target, session_id
FROM {{artifacts}}
WHERE artifact_type IN {WRITES}) w
LEFT JOIN (SELECT session_id, count(*) AS n
FROM {{artifacts}}
WHERE artifact_type = 'error'
GROUP BY session_id) e ON e.session_id = w.session_id
GROUP BY w.target
ORDER BY errors DESC, w.target LIMIT 20""",
    "hourly_productivity": f"""
SELECT substr(m.timestamp, 12, 2) AS hour, count(*) AS artifacts, count(CASE WHEN a.artifact_type IN {WRITES} THEN 1 END) AS writes,
  count(CASE WHEN a.artifact_type = 'error' THEN 1 END) AS errors
FROM {{artifacts}} a
JOIN {{messages}} m ON m.session_id = a.session_id AND m.sequence = a.sequence
GROUP BY substr(m.timestamp, 12, 2)""",
    "zero_write_sessions": f"""
SELECT session_id, count(*) AS artifacts
FROM {{artifacts}}
GROUP BY session_id
HAVING sum(CASE WHEN artifact_type IN {WRITES} THEN 1 ELSE 0 END) = 0""",
    "command_categories": """
SELECT category, count(*) AS n, round(count(*) * 100.0E0 / (SELECT count(*)
FROM {artifacts}
WHERE artifact_type = 'command'), 2) AS pct
FROM (SELECT CASE WHEN target LIKE 'git %' THEN 'git' WHEN regexp_like(target, 'pytest|jest|test') THEN 'test' WHEN regexp_like(target,
  'build|make|npm') THEN 'build' WHEN regexp_like(target, '^(ls|cd|pwd|cat) ') THEN 'navigation' ELSE 'other' END AS category
FROM {artifacts}
WHERE artifact_type = 'command') c
GROUP BY category""",
    "messages_to_first_edit": f"""
SELECT bucket, count(*) AS sessions, CAST(median(first_edit) AS DOUBLE) AS median_messages
FROM (SELECT first_edit, CASE WHEN first_edit < 10 THEN 'a: under 10' WHEN first_edit < 25 THEN 'b: under 25' WHEN first_edit < 50
  THEN 'c: under 50' ELSE 'd: 50 or more' END AS bucket
FROM (SELECT session_id, min(sequence) AS first_edit
FROM {{artifacts}}
WHERE artifact_type IN {WRITES}
GROUP BY session_id) f) b
GROUP BY bucket""",
    "first_messages_tools": """
SELECT coalesce(tool_name, 'none') AS tool, count(*) AS n
FROM {messages}
WHERE sequence < 10
GROUP BY coalesce(tool_name, 'none')""",
    "rediscovery": f"""
SELECT s.project, count(*) AS reads, count(CASE WHEN seen > 1 THEN 1 END) AS again,
  {quotient('count(CASE WHEN seen > 1 THEN 1 END) * 100', 'count(*)', 2)} AS pct
FROM (SELECT r.*, row_number() OVER (PARTITION BY project, target
ORDER BY created_at, session_id) AS seen
FROM (SELECT DISTINCT s.project, a.target, a.session_id, s.created_at
FROM {{artifacts}} a
JOIN {{sessions}} s ON s.session_id = a.session_id
WHERE a.artifact_type = 'file_read') r) s
GROUP BY s.project""",
    "last_session_summary": f"""
SELECT r.project, r.session_id, r.message_count, a.edited, a.files, a.first_command, a.commands, a.errors
FROM ({RECENT}) r
LEFT JOIN (SELECT session_id, array_join(slice(array_sort(collect_set(CASE WHEN artifact_type IN {WRITES} THEN target END)), 1, 3), ', ')
  AS files, min_by(CASE WHEN artifact_type = 'command' AND NOT regexp_like(target, '^(cd|ls)') THEN target END, CASE
  WHEN artifact_type = 'command' AND NOT regexp_like(target, '^(cd|ls)') THEN sequence END) AS first_command, count(DISTINCT CASE
  WHEN artifact_type IN {WRITES} THEN target END) AS edited, count(CASE WHEN artifact_type = 'command' AND NOT regexp_like(target,
  '^(cd|ls)') THEN 1 END) AS commands, count(CASE WHEN artifact_type = 'error' THEN 1 END) AS errors
FROM {{artifacts}}
GROUP BY session_id) a ON a.session_id = r.session_id
WHERE r.recency = 1""",
    # calls
    "sessionize": f"""
SELECT project, ordinal, min(id) AS first_call, count(*) AS turns, min(timestamp) AS started_at, max(timestamp) AS ended_at
FROM ({SESSIONISED.replace('GAP', str(GAP_SECONDS))}) s
GROUP BY project, ordinal""",
    "sessionize_daily": f"""
SELECT project, ordinal, min(id) AS first_call, count(*) AS turns, min(timestamp) AS started_at, max(timestamp) AS ended_at
FROM ({SESSIONISED.replace('GAP', '86400')}) s
GROUP BY project, ordinal""",
    "session_metrics": f"SELECT {METRIC_COLUMNS} FROM ({METRICS.replace('GAP', '86400')}) m",
    "correction_cycles": f"""
SELECT project, ordinal, correction_cycles, CASE WHEN correction_cycles > 0 THEN outcome END AS loop_outcome
FROM ({METRICS.replace('GAP', '86400')}) m""",
    "length_category": f"SELECT length_category, outcome, count(*) AS n FROM ({METRICS.replace('GAP', '86400')}) m GROUP BY length_category, outcome",
    "turn_metrics": f"""
SELECT project, ordinal, turn, input_tokens, output_tokens, CAST(sum(micros) OVER (PARTITION BY project, ordinal
ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) / 1.0E6 AS cumulative_cost, CASE
  WHEN cache_read_tokens + input_tokens > 0 THEN {quotient('cache_read_tokens', 'cache_read_tokens + input_tokens', 4)} ELSE 0.0E0 END
  AS cache_hit_ratio, tools_used
FROM ({TURNS.replace('GAP', '86400')}) t""",
    "proxy_stats": f"""
SELECT count(*) AS calls, {total('input_tokens')} AS input_tokens, {total('output_tokens')} AS output_tokens, {total('cache_read_tokens')}
  AS cache_read, {dollars('CAST(coalesce(sum(' + micro('cost_estimate_usd') + '), 0) AS BIGINT) * 100', 4)} AS cost, min(timestamp)
  AS first_at, max(timestamp) AS last_at
FROM {{calls}}""",
    "proxy_calls": """
SELECT id, timestamp, model, input_tokens, output_tokens, cost_estimate_usd, stop_reason
FROM {calls}
ORDER BY timestamp DESC, id DESC LIMIT 20""",
    "proxy_report": f"""
SELECT v.*, CASE WHEN b.avg_input > 0 THEN round((v.avg_input - b.avg_input) * 100.0E0 / b.avg_input, 3) END AS input_delta_pct
FROM (SELECT coalesce(enrichment_variant, 'baseline') AS variant, count(*) AS calls, {mean('input_tokens', 4)} AS avg_input,
  {mean('output_tokens', 4)} AS avg_output, {dollars('CAST(coalesce(sum(' + micro('cost_estimate_usd') + '), 0) AS BIGINT) * 100', 4)}
  AS cost
FROM {{calls}}
GROUP BY coalesce(enrichment_variant, 'baseline')) v
LEFT JOIN (SELECT {mean('input_tokens', 4)} AS avg_input
FROM {{calls}}
WHERE enrichment_variant IS NULL) b ON v.variant != 'baseline'""",
    "variant_comparison": f"""
SELECT coalesce(variant, 'baseline') AS variant, count(*) AS sessions, {mean('first_edit', 4)} AS first_edit, {mean('exploration_turns', 4)}
  AS exploration_turns, {mean('exploration_micros', 0)} / 1.0E6 AS exploration_cost, {mean('turns', 4)} AS turns,
  {mean('total_micros', 0)} / 1.0E6 AS cost, {mean('reads_before_edit', 4)} AS reads, {mean('errors_count', 4)} AS errors
FROM ({METRICS.replace('GAP', '86400')}) m
WHERE turns >= 3
GROUP BY coalesce(variant, 'baseline')""",
    "variant_by_length": f"""
SELECT coalesce(variant, 'baseline') AS variant, length_category, count(*) AS sessions, {mean('turns', 4)} AS turns,
  {mean('total_micros', 0)} / 1.0E6 AS cost
FROM ({METRICS.replace('GAP', '86400')}) m
GROUP BY coalesce(variant, 'baseline'), length_category""",
    "variant_cost_window": f"""
SELECT {dollars('CAST(coalesce(sum(' + micro('cost_estimate_usd') + '), 0) AS BIGINT) * 100', 4)} AS cost, min(id) AS first_call, count(*)
  AS calls
FROM {{calls}}
WHERE ts_s > {{from_s}} AND ts_s < {{to_s}} AND enrichment_variant IS NULL""",
    # worktrees
    "worktree_result": WORKTREE_RESULT,
    "ab_compare": f"""
SELECT a.id AS id_a, b.id AS id_b, a.duration_seconds AS duration_a, b.duration_seconds AS duration_b, CASE
  WHEN a.duration_seconds < b.duration_seconds THEN 'a' WHEN a.duration_seconds > b.duration_seconds THEN 'b' ELSE 'tie' END AS winner, CASE
  WHEN a.duration_seconds != 0 THEN round((b.duration_seconds - a.duration_seconds) * 100.0E0 / a.duration_seconds, 2) END AS delta_pct,
  {lower('cycles')}, {lower('failures')}
FROM ({WORKTREE_RESULT}) a
JOIN ({WORKTREE_RESULT}) b ON b.id = a.id + 1
WHERE a.ab_variant_label = 'a'""",
    "worktrees_by_status": "SELECT id, branch_name, task_description FROM {worktrees} WHERE status = {status} ORDER BY id DESC LIMIT 50",
    "correction_counts": """
SELECT worktree_id, count(*) AS cycles, max(cycle_number) AS latest, substr(max(lpad(CAST(cycle_number AS STRING), 6, '0') || outcome), 7)
  AS latest_outcome
FROM {cycles}
GROUP BY worktree_id""",
    "latest_checkpoint": """
SELECT worktree_id, max(id) AS id, substr(max(lpad(CAST(id AS STRING), 18, '0') || git_sha), 19) AS git_sha, substr(max(lpad(CAST(id
  AS STRING), 18, '0') || file), 19) AS file
FROM {checkpoints}
GROUP BY worktree_id""",
    "status_transition": """
SELECT id, branch_name, CASE WHEN status = 'active' THEN 'merged' ELSE status END AS status, CASE WHEN status IN ('active', 'passed',
  'failed', 'escalated', 'merged') THEN {now_s} END AS resolved_s
FROM {worktrees}""",
    "worktree_with_cycles": """
SELECT w.id, w.branch_name, w.status, c.cycles, k.checkpoint_id, k.git_sha
FROM {worktrees} w
LEFT JOIN (SELECT worktree_id, array_join(transform(array_sort(collect_list(named_struct('n', cycle_number, 'outcome', outcome))),
  x -> x.n || ':' || x.outcome), ',') AS cycles
FROM {cycles}
GROUP BY worktree_id) c ON c.worktree_id = w.id
LEFT JOIN (SELECT worktree_id, max(id) AS checkpoint_id, max_by(git_sha, named_struct('id', id, 'sha', git_sha)) AS git_sha
FROM {checkpoints}
GROUP BY worktree_id) k ON k.worktree_id = w.id""",
    "experiments": f"SELECT experiment_id, enriched_status, baseline_status, duration_delta_pct, {OUTCOME} AS outcome FROM {{experiments}}",
    "experiment_outcome": f"SELECT outcome, count(*) AS n FROM (SELECT {OUTCOME} AS outcome FROM {{experiments}}) y GROUP BY outcome",
    # messages
    "session_intents": f"""
SELECT r.project, r.session_id, substr(m.content, 1, 200) AS intent
FROM ({RECENT}) r
JOIN ({FIRST_USER}) f ON f.session_id = r.session_id
JOIN {{messages}} m ON m.session_id = f.session_id AND m.sequence = f.sequence""",
    "last_messages": f"""
SELECT project, session_id, sequence, content
FROM (SELECT r.project, m.session_id, m.sequence, m.content, row_number() OVER (PARTITION BY r.project
ORDER BY m.sequence DESC) AS n
FROM ({RECENT}) r
JOIN {{messages}} m ON m.session_id = r.session_id
WHERE r.recency = 1 AND m.role = 'assistant') x
WHERE n <= 3""",
    "recent_sessions": f"""
SELECT r.project, r.session_id, r.message_count, substr(i.content, 1, 200) AS intent, t.tool, t.n
FROM ({RECENT}) r
LEFT JOIN ({FIRST_MEANT}) f ON f.session_id = r.session_id
LEFT JOIN {{messages}} i ON i.session_id = f.session_id AND i.sequence = f.sequence
LEFT JOIN (SELECT session_id, tool, n
FROM (SELECT session_id, tool_name AS tool, count(*) AS n, row_number() OVER (PARTITION BY session_id
ORDER BY count(*) DESC, tool_name) AS rank
FROM {{messages}}
WHERE tool_name IS NOT NULL
GROUP BY session_id, tool_name) x
WHERE rank <= 5) t ON t.session_id = r.session_id""",
    "enrich_text": """
SELECT m.id, substr('[Project: ' || coalesce(s.project, 'unknown') || ' | Role: ' || m.role || CASE WHEN m.tool_name IS NOT NULL
  THEN ' | Tool: ' || m.tool_name ELSE '' END || '] ' || m.content, 1, 8000) AS text
FROM {messages} m
LEFT JOIN {sessions} s ON s.session_id = m.session_id""",
    "pending_embeddings": """
SELECT m.id
FROM {messages} m
LEFT ANTI JOIN {vectors} v ON v.message_id = m.id
WHERE m.content IS NOT NULL AND length(trim(m.content)) > 10""",
    # graph
    "graph_file_nodes": f"""
SELECT f.*, regexp_extract(f.path, '[^/]+$', 0) AS name, l.last_seen, l.project
FROM ({FILE_NODES}) f
LEFT JOIN (SELECT a.target, max(m.timestamp) AS last_seen, max_by(s.project, a.id) AS project
FROM {{artifacts}} a
JOIN {{messages}} m ON m.session_id = a.session_id AND m.sequence = a.sequence
JOIN {{sessions}} s ON s.session_id = a.session_id
WHERE a.artifact_type IN ('file_read', 'file_write', 'file_create')
GROUP BY a.target) l ON l.target = f.path""",
    "graph_session_nodes": f"""
SELECT s.session_id, s.project, s.message_count, p.tokens_in, p.tokens_out, p.cache_read, p.cache_create,
  {dollars('coalesce(p.cost_units, 0)', 4)} AS cost,
  {quotient('timestampdiff(SECOND, CAST(s.created_at AS TIMESTAMP_NTZ), CAST(s.updated_at AS TIMESTAMP_NTZ))', '60', 1)} AS duration_minutes
FROM {{sessions}} s
LEFT JOIN ({PER_SESSION}) p ON p.session_id = s.session_id""",
    "graph_touched": f"""
SELECT session_id, target AS path, count(CASE WHEN artifact_type = 'file_read' THEN 1 END) AS reads, count(CASE
  WHEN artifact_type IN {WRITES} THEN 1 END) AS writes
FROM {{artifacts}}
WHERE artifact_type LIKE 'file%' AND target NOT LIKE '%*%'
GROUP BY session_id, target""",
    "graph_co_change": f"SELECT file_a, file_b, co_sessions FROM ({CO_CHANGE}) c WHERE co_sessions >= 2",
    "graph_errors": f"""
SELECT substr(a.target, 1, 100) AS pattern, min(a.target) AS message, count(*) AS frequency, min(m.timestamp) AS first_seen, max(m.timestamp) AS last_seen
FROM {{artifacts}} a
LEFT JOIN {{messages}} m ON m.id = a.id
WHERE a.artifact_type = 'error' AND {real_error('a.')}
GROUP BY substr(a.target, 1, 100)""",
    "causes_error": f"""
SELECT c.pattern, c.path, c.n, {quotient('c.n', 'greatest(coalesce(w.writes, 0), 1)', 6)} AS ratio
FROM ({CAUSES}) c
LEFT JOIN (SELECT target, count(*) AS writes
FROM {{artifacts}}
WHERE artifact_type IN {WRITES}
GROUP BY target) w ON w.target = c.path""",
    "danger_ratio": f"""
SELECT f.path, {quotient('CAST(sum(c.n) AS BIGINT)', 'max(CASE WHEN f.writes = 0 THEN 1 ELSE f.writes END)', 6)} AS danger_ratio
FROM ({FILE_NODES}) f
JOIN ({CAUSES}) c ON c.path = f.path
GROUP BY f.path""",
    "tested_by": f"""
SELECT CASE WHEN regexp_like(file_a, '{IS_TEST}') THEN file_b ELSE file_a END AS source, CASE WHEN regexp_like(file_a, '{IS_TEST}')
  THEN file_a ELSE file_b END AS test_file, co_sessions
FROM ({CO_CHANGE}) c
WHERE co_sessions >= 2 AND regexp_like(file_a, '{IS_TEST}') != regexp_like(file_b, '{IS_TEST}')""",
    "error_chains": f"""
SELECT a.path AS path_a, b.path AS path_b, count(*) AS shared_errors
FROM ({CAUSES}) a
JOIN ({CAUSES}) b ON a.pattern = b.pattern AND a.path < b.path
GROUP BY a.path, b.path
ORDER BY shared_errors DESC, path_a, path_b LIMIT 10""",
}

#: Functions that DuckDB spells otherwise.
SPELLINGS = {"regexp_like(": "regexp_matches(", "LEFT ANTI JOIN": "ANTI JOIN", " DIV ": " // ", "last_value(mark) IGNORE NULLS": "last_value(mark IGNORE NULLS)", "explode(array(": "unnest([", ")) AS band": "]) AS band"}


def to_duckdb(plan: str) -> str:
    for spark, duck in SPELLINGS.items():
        plan = plan.replace(spark, duck)
    return plan
