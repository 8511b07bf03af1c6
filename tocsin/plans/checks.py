"""Check SQL for the registered queries, written for the check database.

The statements share their input views with the Spark side and nothing else:
they reach each result in their own way (joins, row numbers, list functions).
"""

from __future__ import annotations

from tocsin.operators import answers, governance, metrics, prompts, reports, validation
from tocsin.plans import inputs
from tocsin.plans.inputs import CHECK, quoted

RULES = governance.Rules()
WORDS = {"FATAL": "FATAL|PANIC", "ERROR": "ERROR|EXCEPTION|TRACEBACK"}
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANKS = r"[\t-\r\x1c-\x20]"

# The check database's regexes know no lookahead.  This spells out what may
# follow the table name instead: anything that is not white space and WHERE.
GUARDED_DELETE = (
    r"\bDELETE\s+FROM\s+(\w\w|\w$|\w[^\w\s]|\w\s+$|\w\s+([^\sW]|W$|W[^H]|WH$|WH[^E]|"
    r"WHE$|WHE[^R]|WHER$|WHER[^E]))"
)

_VIEWS: dict[str, tuple[list[str], str]] = {}
_CHECKS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], sql: str) -> None:
    _VIEWS[name] = (needs, sql)


def check(name: str, needs: list[str], sql: str) -> None:
    _CHECKS[name] = (needs, sql)


def _in_order(needs: list[str], seen: list[str]) -> list[str]:
    for name in needs:
        if name in _VIEWS and name not in seen:
            _in_order(_VIEWS[name][0], seen)
            seen.append(name)
    return seen


def all_sql() -> dict[str, str]:
    statements = {}
    for name, (needs, sql) in _CHECKS.items():
        parts = [f"{v} AS ({_VIEWS[v][1]})" for v in _in_order(needs, [])]
        statements[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql
    return statements


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _tier(raw: str) -> str:
    tests = " ".join(
        f"WHEN regexp_matches({raw}, '(?i)\\b({words})\\b') THEN '{tier}'"
        for tier, words in WORDS.items()
    )
    return f"CASE {tests} ELSE 'NOISE' END"


def _text(items: str) -> str:
    return f"array_to_string({items}, '|')"


# --- log lines ---------------------------------------------------------------

view("requests", [], f"SELECT {_columns(inputs.request_columns(CHECK))} FROM documents")
view(
    "dumped",
    ["requests"],
    f"SELECT request_id, string_split_regex(log_payload, '{BREAKS}') AS pieces FROM requests",
)
view(
    "cut",
    ["dumped"],
    "SELECT request_id, CASE WHEN pieces[-1] = '' THEN pieces[1:len(pieces) - 1] ELSE pieces END "
    "AS pieces FROM dumped",
)
view(
    "dump_lines",
    ["cut"],
    "SELECT request_id, CAST(i - 1 AS BIGINT) AS line_no, pieces[i] AS raw FROM "
    "(SELECT request_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM cut)",
)
view("dump_tags", ["dump_lines"], f"SELECT *, {_tier('raw')} AS severity FROM dump_lines")
view(
    "log_lines",
    [],
    "SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY ts, event_id) - 1 AS "
    f"line_no, raw FROM (SELECT {_columns(inputs.line_columns(CHECK))} FROM events)",
)
view("tagged", ["log_lines"], f"SELECT *, {_tier('raw')} AS severity FROM log_lines")


def _anchors(lines: str, key: str) -> str:
    return (
        f"SELECT {key}, coalesce(f, e) AS anchor, CASE WHEN f IS NOT NULL THEN 'FATAL' WHEN e IS NOT "
        f"NULL THEN 'ERROR' END AS severity, n AS n_lines FROM (SELECT {key}, count(*) AS n, "
        "min(line_no) FILTER (severity = 'FATAL') AS f, min(line_no) FILTER (severity = 'ERROR') AS e "
        f"FROM {lines} GROUP BY {key})"
    )


def _contexts(lines: str, anchors: str, key: str, window: str) -> str:
    return (
        f"SELECT a.{key}, string_agg(raw, chr(10) ORDER BY line_no) AS context, count(*) AS n_context "
        f"FROM {lines} l JOIN {anchors} a ON l.{key} = a.{key} AND line_no BETWEEN anchor - {window} "
        f"AND anchor + {window} GROUP BY a.{key}"
    )


LINE_WINDOW = f"(a.{inputs.LINE_WINDOW})"
view("anchors", ["tagged"], _anchors("tagged", "incident_id"))
view(
    "contexts", ["log_lines", "anchors"], _contexts("log_lines", "anchors", "incident_id", LINE_WINDOW)
)
view(
    "line_stage",
    ["anchors", "contexts"],
    "SELECT a.incident_id, n_lines, anchor, severity, context, coalesce(n_context, 0) AS n_context, "
    "CAST(coalesce(length(context) // 4, 0) AS INTEGER) AS est_tokens "
    "FROM anchors a LEFT JOIN contexts c ON a.incident_id = c.incident_id",
)
check("log_lines", ["dump_lines"], "SELECT * FROM dump_lines")
check("severity_tags", ["dump_tags"], "SELECT request_id, line_no, severity FROM dump_tags")
check("severity_filter", ["tagged"], "SELECT * FROM tagged WHERE severity = 'FATAL'")
check("crash_anchor", ["anchors"], "SELECT incident_id, anchor FROM anchors")
check(
    "anchor_severity",
    ["anchors"],
    "SELECT incident_id, severity AS anchor_severity FROM anchors WHERE anchor IS NOT NULL",
)
check(
    "context_window",
    ["log_lines", "anchors"],
    "SELECT l.incident_id, line_no, raw, anchor FROM log_lines l JOIN anchors a ON l.incident_id = "
    f"a.incident_id AND line_no BETWEEN anchor - {LINE_WINDOW} AND anchor + {LINE_WINDOW}",
)
check("context_text", ["contexts"], "SELECT * FROM contexts")
check("token_estimate", ["line_stage"], "SELECT incident_id, est_tokens FROM line_stage")
check("preprocess_lines", ["line_stage"], "SELECT * FROM line_stage")
check(
    "noise_reduction",
    ["line_stage"],
    "SELECT coalesce(severity, 'NOISE') AS severity, count(*) AS incidents, CAST(sum(n_lines) AS "
    "BIGINT) AS lines_in, CAST(sum(n_context) AS BIGINT) AS lines_kept, 1 - CAST(sum(n_context) AS "
    "DOUBLE) / CAST(sum(n_lines) AS DOUBLE) AS reduction FROM line_stage GROUP BY 1",
)

# --- requests ----------------------------------------------------------------

_REQUEST_TESTS = {
    "service_name": "length(service_name) BETWEEN 1 AND 128",
    "environment": "environment IN ('dev', 'staging', 'prod')",
    "log_payload": "length(log_payload) BETWEEN 1 AND 2000000",
    "max_context_lines": "max_context_lines BETWEEN 1 AND 50",
}
view(
    "defaulted",
    ["requests"],
    "SELECT * REPLACE (coalesce(max_context_lines, 10) AS max_context_lines) FROM requests",
)
view(
    "checked",
    ["defaulted"],
    "SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN NOT {test} THEN '{n}' END" for n, test in _REQUEST_TESTS.items())
    + "], lambda x: x IS NOT NULL) AS errors FROM defaulted",
)
view("valid", ["checked"], "SELECT * EXCLUDE (errors) FROM checked WHERE len(errors) = 0")
check("validate_requests", ["valid"], "SELECT * FROM valid")
check(
    "quarantine_requests",
    ["checked"],
    "SELECT request_id, service_name, environment, max_context_lines, unnest(errors) AS error "
    "FROM checked",
)
check(
    "ingest_requests",
    ["checked"],
    f"SELECT * REPLACE ({_text('errors')} AS errors) FROM checked",
)
view(
    "log_files",
    ["requests"],
    f"SELECT request_id // {inputs.DUMPS_PER_FILE} AS n, string_agg(log_payload, chr(10) ORDER BY request_id) AS text "
    "FROM requests GROUP BY n HAVING string_agg(log_payload, chr(10) ORDER BY request_id) <> ''",
)
view(
    "log_file_pieces",
    ["log_files"],
    f"SELECT *, string_split_regex(text, '{BREAKS}') AS pieces FROM log_files",
)
view(
    "log_file_lines",
    ["log_file_pieces"],
    "SELECT n, 'svc-' || n AS service_name, text, CASE WHEN pieces[-1] = '' THEN pieces[1:len(pieces) - 1] ELSE pieces "
    "END AS pieces FROM log_file_pieces",
)
check(
    "scan_log_files",
    ["log_file_lines"],
    "SELECT service_name, 'prod' AS environment, CAST(10 AS BIGINT) AS max_context_lines, '' AS errors, "
    "CAST(len(pieces) AS BIGINT) AS lines, CAST(length(text) AS BIGINT) AS characters, sha256(text) AS payload_sha256 "
    "FROM log_file_lines",
)
check(
    "scan_log_lines",
    ["log_file_lines"],
    f"SELECT service_name, {_tier('raw')} AS severity, count(*) AS lines, min(line_no) AS first, max(line_no) AS last, "
    "CAST(sum(line_no * length(raw)) AS BIGINT) AS weighted FROM (SELECT service_name, CAST(i - 1 AS BIGINT) AS line_no, "
    "pieces[i] AS raw FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM log_file_lines)) GROUP BY 1, 2",
)
view("dump_anchors", ["dump_tags"], _anchors("dump_tags", "request_id"))
view(
    "dump_anchored",
    ["dump_anchors", "valid"],
    "SELECT a.*, max_context_lines FROM dump_anchors a JOIN valid v ON a.request_id = v.request_id",
)
view(
    "dump_contexts",
    ["dump_lines", "dump_anchored"],
    _contexts("dump_lines", "dump_anchored", "request_id", "max_context_lines"),
)
_KEY_TEXT = "concat_ws(chr(31), CAST(request_id AS VARCHAR), service_name, environment)"
_UUID = (
    "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"
)
view(
    "incidents",
    ["valid", "dump_anchors", "dump_contexts"],
    "SELECT v.request_id, v.service_name, v.environment, v.max_context_lines, coalesce(n_lines, 0) AS "
    "n_lines, anchor, severity, context, coalesce(n_context, 0) AS n_context, CAST(coalesce("
    "length(context) // 4, 0) AS INTEGER) AS est_tokens, incident_key FROM (SELECT *, "
    f"{_UUID} AS incident_key FROM (SELECT *, md5({_KEY_TEXT}) AS h FROM valid)) v "
    "LEFT JOIN dump_anchors a ON v.request_id = a.request_id "
    "LEFT JOIN dump_contexts c ON v.request_id = c.request_id",
)
check(
    "preprocess_array",
    ["incidents"],
    "SELECT request_id, n_lines, anchor, severity, context, n_context, est_tokens FROM incidents",
)
check(
    "context_bound",
    ["incidents"],
    "SELECT max_context_lines AS \"window\", count(*) AS incidents, max(n_context) AS longest, "
    "max(n_context) <= 2 * max_context_lines + 1 AS within_bound FROM incidents "
    "GROUP BY max_context_lines",
)
check(
    "incident_key",
    ["requests"],
    f"SELECT request_id, {_UUID} AS incident_key FROM (SELECT request_id, md5({_KEY_TEXT}) AS h "
    "FROM requests)",
)

# --- rules and commands ------------------------------------------------------


def _deny_ladder(cmd: str, result) -> str:
    tests = []
    for n, pattern in enumerate(RULES.deny, 1):
        known = GUARDED_DELETE if "(?!" in pattern else pattern
        tests.append(f"WHEN regexp_matches({cmd}, {quoted('(?i)' + known)}) THEN {result(n, pattern)}")
    return f"CASE {' '.join(tests)} END"


def _allow_ladder(cmd: str) -> str:
    tests = [
        f"WHEN command_type = {quoted(kind)} AND starts_with({cmd}, {quoted(p)}) THEN {quoted(p)}"
        for kind, prefixes in RULES.allow.items()
        for p in prefixes
    ]
    return f"CASE {' '.join(tests)} END"


def _decide(source: str, key: str) -> str:
    """Judge and decide a view of proposals in three nested selects."""
    cmd = f"regexp_replace(coalesce(remediation_command, ''), '^{BLANKS}+|{BLANKS}+$', '', 'g')"
    cleaned = f"SELECT *, {cmd} AS cmd FROM {source}"
    denied = (
        "SELECT *, command_type = 'none' OR cmd = '' AS noop, "
        f"{_deny_ladder('cmd', lambda n, p: n)} AS hit FROM ({cleaned})"
    )
    judged = (
        f"SELECT *, CASE WHEN NOT noop THEN {CHECK.pick('hit - 1', [quoted(p) for p in RULES.deny])} END "
        f"AS deny_pattern, CASE WHEN NOT noop AND hit IS NULL THEN {_allow_ladder('cmd')} END AS verb "
        f"FROM ({denied})"
    )
    before, after = governance.DENIED.split("{}")
    fate = (
        "CASE WHEN noop THEN 'noop' WHEN hit IS NOT NULL THEN 'deny' WHEN verb IS NULL OR "
        "requires_human_approval THEN 'hold' ELSE 'go' END"
    )
    return (
        f"SELECT {key}, cmd, noop, hit, verb, requires_human_approval, deny_pattern, "
        "CASE WHEN fate = 'go' THEN cmd END AS command, "
        "CASE WHEN noop THEN 'none' ELSE command_type END AS decided_type, "
        "CASE WHEN fate IN ('noop', 'go') THEN 'APPROVED' ELSE 'BLOCKED_ESCALATED' END AS status, "
        f"CASE fate WHEN 'deny' THEN {quoted(before)} || deny_pattern || {quoted(after)} "
        f"WHEN 'hold' THEN {quoted(governance.NOT_ALLOWED)} END AS block_reason, "
        "CASE WHEN fate = 'hold' OR runbook_steps IS NULL THEN '' ELSE "
        f"{_text('runbook_steps')} END AS steps, fate IN ('deny', 'hold') AS guardrail_triggered, "
        "deny_pattern AS matched_denylist_pattern, CASE WHEN fate = 'go' THEN verb END AS "
        f"allowlist_verb FROM (SELECT *, {fate} AS fate FROM ({judged}))"
    )


DECISION = (
    "command, decided_type, status, block_reason, steps, guardrail_triggered, "
    "matched_denylist_pattern, allowlist_verb"
)
view("commands", [], f"SELECT {_columns(inputs.command_columns(CHECK))} FROM events")
view("decided", ["commands"], _decide("commands", "command_id, command_type"))
check("gov_normalize", ["decided"], "SELECT command_id, cmd AS command FROM decided")
check(
    "gov_noop",
    ["decided"],
    "SELECT command_id, status, command, steps AS runbook_steps, guardrail_triggered FROM decided "
    "WHERE noop",
)
check(
    "gov_deny",
    ["decided"],
    "SELECT command_id, deny_pattern FROM decided WHERE deny_pattern IS NOT NULL",
)
check(
    "gov_deny_join",
    ["decided"],
    "SELECT command_id, hit AS ordinal, deny_pattern AS pattern FROM decided WHERE deny_pattern IS NOT NULL",
)
check(
    "gov_allow",
    ["decided"],
    "SELECT command_id, command_type, verb FROM decided WHERE verb IS NOT NULL",
)
_MORE_DENY = inputs.LARGE_DENY - len(RULES.deny)
_MORE_ALLOW = inputs.LARGE_ALLOW - sum(map(len, RULES.allow.values()))
view(
    "largely_judged",
    ["decided"],
    "SELECT command_id, command_type, CASE WHEN hit IS NOT NULL THEN deny_pattern WHEN number IS NOT NULL AND "
    f"number < {_MORE_DENY} THEN '\\bworker-' || number || '\\b' END AS deny_pattern, CASE WHEN verb IS NOT NULL THEN verb WHEN "
    f"place < {_MORE_ALLOW} AND command_type = 'shell' THEN 'bash /srv/' || place || '/' END AS verb FROM (SELECT *, "
    "TRY_CAST(regexp_extract(cmd, '(?i)\\bworker-([0-9]+)\\b', 1) AS BIGINT) AS number, "
    "TRY_CAST(regexp_extract(cmd, '^bash /srv/([0-9]+)/', 1) AS BIGINT) AS place FROM decided WHERE NOT noop)",
)
check(
    "gov_deny_large",
    ["largely_judged"],
    "SELECT command_id, deny_pattern FROM largely_judged WHERE deny_pattern IS NOT NULL",
)
check(
    "gov_allow_large",
    ["largely_judged"],
    "SELECT command_id, command_type, verb FROM largely_judged WHERE deny_pattern IS NULL AND verb IS NOT NULL",
)
check(
    "gov_approval",
    ["decided"],
    "SELECT command_id, verb AS matching_prefix, status, allowlist_verb FROM decided WHERE "
    "requires_human_approval AND NOT noop AND hit IS NULL",
)
check("gov_decision", ["decided"], f"SELECT command_id, {DECISION} FROM decided")
check(
    "gov_reason",
    ["decided"],
    "SELECT command_id, block_reason FROM decided WHERE block_reason IS NOT NULL",
)
check(
    "gov_summary",
    ["decided"],
    "SELECT status, decided_type AS command_type, deny_pattern AS pattern, count(*) AS commands "
    "FROM decided GROUP BY ALL",
)
_RULE_ROWS = ", ".join(
    f"({quoted(kind)}, {'NULL' if ctype is None else quoted(ctype)}, {n}, {quoted(pattern)})"
    for kind, ctype, n, pattern in RULES.rows()
)
view("rules", [], f"SELECT * FROM (VALUES {_RULE_ROWS}) AS r(kind, command_type, ordinal, pattern)")
check(
    "rules_table",
    ["rules", "decided"],
    "SELECT kind, r.command_type, ordinal, pattern, count(command_id) AS commands FROM rules r LEFT "
    "JOIN decided d ON CASE WHEN kind = 'deny' THEN d.deny_pattern = r.pattern ELSE d.verb = r.pattern "
    "AND d.command_type = r.command_type END GROUP BY ALL",
)

# --- answers -----------------------------------------------------------------

_ANSWER_COLUMNS = inputs.answer_columns(CHECK)


def _attempts() -> str:
    columns, source = dict(_ANSWER_COLUMNS), "events"
    for step in inputs.ANSWER_STEPS:
        made = _columns({name: columns.pop(name) for name in step})
        source = f"(SELECT *, {made} FROM {source})"
    return f"SELECT {_columns(columns)} FROM {source}"


view("attempts", [], _attempts())


def _tokens(kind: str) -> str:
    own = f"coalesce(primary_{kind}_tokens, 0)"
    return (
        f"CASE WHEN length(coalesce(primary_text, '')) > 0 THEN {own} ELSE "
        f"coalesce(fallback_{kind}_tokens, {own}) END"
    )


view(
    "chosen",
    ["attempts"],
    "SELECT incident_id, agent, attempt, prompt, ms, CASE WHEN length(coalesce(primary_text, '')) > 0 "
    "THEN primary_text WHEN length(coalesce(fallback_text, '')) > 0 THEN fallback_text END AS raw_answer, "
    "CASE WHEN length(coalesce(primary_text, '')) > 0 THEN 'primary' WHEN "
    "length(coalesce(fallback_text, '')) > 0 THEN 'fallback' END AS transport, "
    f"{_tokens('prompt')} AS reported_prompt_tokens, {_tokens('completion')} AS "
    "reported_completion_tokens FROM attempts",
)
_TRIM = f"'^{BLANKS}+|{BLANKS}+$', '', 'g'"
view(
    "cleaned",
    ["chosen"],
    f"SELECT *, regexp_replace(CASE WHEN ends_with(c, '```') THEN left(c, length(c) - 3) ELSE c END, "
    f"{_TRIM}) AS answer_text FROM (SELECT *, CASE WHEN starts_with(b, '```') THEN b[4:] ELSE b END AS c "
    "FROM (SELECT *, CASE WHEN starts_with(a, '```json') THEN a[8:] ELSE a END AS b FROM (SELECT *, "
    f"regexp_replace(raw_answer, {_TRIM}) AS a FROM chosen)))",
)
view(
    "counted",
    ["cleaned"],
    "SELECT *, CASE WHEN reported_prompt_tokens = 0 THEN length(prompt) // 4 ELSE "
    "reported_prompt_tokens END AS prompt_tokens, CASE WHEN reported_completion_tokens = 0 THEN "
    "length(answer_text) // 4 ELSE reported_completion_tokens END AS completion_tokens, "
    "CASE WHEN json_type(TRY_CAST(answer_text AS JSON)) = 'OBJECT' THEN TRY_CAST(answer_text AS JSON) "
    "END AS j FROM cleaned",
)
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _read(field: validation.Field) -> str:
    path = f"'$.{field.name}'"
    kind, text = f"json_type(j, {path})", f"json_extract_string(j, {path})"
    numeric = f"{kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    if field.kind == validation.NUMBER:
        return (
            f"CASE WHEN {numeric} THEN CAST({text} AS DOUBLE) WHEN {kind} = 'BOOLEAN' THEN "
            f"CASE WHEN {text} = 'true' THEN 1.0 ELSE 0.0 END WHEN {kind} = 'VARCHAR' AND "
            f"regexp_matches({text}, '{_NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END"
        )
    if field.kind == validation.FLAG:
        yes, no = (", ".join(map(quoted, w)) for w in (validation.YES, validation.NO))
        return (
            f"CASE WHEN {kind} = 'BOOLEAN' THEN {text} = 'true' WHEN {kind} = 'VARCHAR' AND "
            f"lower({text}) IN ({yes}) THEN true WHEN {kind} = 'VARCHAR' AND lower({text}) IN ({no}) THEN "
            f"false WHEN {numeric} AND CAST({text} AS DOUBLE) = 1 THEN true WHEN {numeric} AND "
            f"CAST({text} AS DOUBLE) = 0 THEN false END"
        )
    if field.kind == validation.TEXTS:
        items = f"json_extract(j, '$.{field.name}[*]')"
        return (
            f"CASE WHEN j IS NOT NULL AND {kind} IS NULL THEN CAST([] AS VARCHAR[]) WHEN {kind} = 'ARRAY' "
            f"AND len(list_filter({items}, lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN "
            f"json_extract_string(j, '$.{field.name}[*]') END"
        )
    value = f"WHEN {kind} = 'VARCHAR' THEN {text} END"
    if field.required:
        return f"CASE {value}"
    return f"CASE WHEN j IS NOT NULL AND {kind} IS NULL THEN {quoted(field.default)} {value}"


def _broken(field: validation.Field) -> str:
    if field.allowed:
        return f"{field.name} NOT IN ({', '.join(map(quoted, field.allowed))})"
    if field.longest:
        return f"length({field.name}) > {field.longest}"
    if field.kind == validation.NUMBER:
        return f"NOT {field.name} BETWEEN 0 AND 1"
    return "false"


def _errors(agent: str) -> str:
    names = ", ".join(
        f"CASE WHEN {f.name} IS NULL OR {_broken(f)} THEN '{f.name}' END" for f in validation.ANSWERS[agent]
    )
    return f"list_filter([{names}], lambda x: x IS NOT NULL)"


_FIELDS = validation.all_fields(inputs.AGENT_NAMES)


def _owned(field: validation.Field) -> str:
    owners = [a for a in inputs.AGENT_NAMES if any(f.name == field.name for f in validation.ANSWERS[a])]
    return f"CASE WHEN agent IN ({', '.join(map(quoted, owners))}) THEN {_read(field)} END"


view("typed", ["counted"], f"SELECT *, {_columns({f.name: _owned(f) for f in _FIELDS})} FROM counted")
_BY_AGENT = " ".join(f"WHEN '{a}' THEN {_errors(a)}" for a in inputs.AGENT_NAMES)
view(
    "parsed",
    ["typed"],
    f"SELECT *, CASE WHEN raw_answer IS NULL THEN [{quoted(answers.NO_ANSWER)}] WHEN j IS NULL THEN "
    f"['json'] ELSE CASE agent {_BY_AGENT} END END AS errors FROM typed",
)
for _agent in inputs.AGENT_NAMES:
    _shown = ", ".join(
        f"{_text(f.name)} AS {f.name}" if f.kind == validation.TEXTS else f.name
        for f in validation.ANSWERS[_agent]
    )
    check(
        f"validate_{_agent}",
        ["parsed"],
        f"SELECT incident_id, attempt, {_text('errors')} AS errors, {_shown} FROM parsed "
        f"WHERE agent = '{_agent}'",
    )
check(
    "transport_fallback",
    ["chosen"],
    "SELECT incident_id, agent, attempt, raw_answer, transport, reported_prompt_tokens, "
    "reported_completion_tokens FROM chosen",
)
check("fence_strip", ["cleaned"], "SELECT incident_id, agent, attempt, answer_text FROM cleaned")
check(
    "parse_answers",
    ["parsed"],
    f"SELECT incident_id, agent, attempt, len(errors) = 0 AS valid, {_text('errors')} AS errors, "
    "severity_detected, root_cause, confidence_score, remediation_command, summary FROM parsed",
)
check(
    "token_fallback",
    ["counted"],
    "SELECT incident_id, agent, attempt, prompt_tokens, completion_tokens FROM counted",
)
view("tried", ["parsed"], "SELECT * FROM parsed WHERE attempt <= 3")
view(
    "won",
    ["tried"],
    "SELECT * FROM tried WHERE len(errors) = 0 QUALIFY row_number() OVER (PARTITION BY incident_id, agent "
    "ORDER BY attempt) = 1",
)
check(
    "first_valid_attempt",
    ["tried", "won"],
    "SELECT t.incident_id, t.agent, w.attempt, w.answer_text, t.tried, CASE WHEN w.attempt IS NULL THEN "
    f"{_text('t.last')} END AS last_error FROM (SELECT incident_id, agent, count(*) AS tried, "
    "arg_max(errors, attempt) AS last FROM tried GROUP BY ALL) t LEFT JOIN won w ON t.incident_id = "
    "w.incident_id AND t.agent = w.agent",
)
view(
    "chains",
    ["won"],
    "SELECT k.incident_id, s.incident_id IS NOT NULL AND d.incident_id IS NOT NULL AND r.incident_id IS "
    "NOT NULL AND p.incident_id IS NOT NULL AS complete, CASE WHEN s.incident_id IS NULL THEN 'severity' "
    "WHEN d.incident_id IS NULL THEN 'diagnostic' WHEN r.incident_id IS NULL THEN 'remediation' WHEN "
    "p.incident_id IS NULL THEN 'postmortem' END AS missing_agent, s.severity_detected AS agent_severity, "
    "d.root_cause, d.confidence_score, d.explanation, r.remediation_command, r.command_type, "
    "r.requires_human_approval, r.runbook_steps, p.summary, p.contributing_factors, p.preventive_actions, "
    "p.impact_assessment, s.prompt_tokens + d.prompt_tokens + r.prompt_tokens + p.prompt_tokens AS "
    "prompt_tokens, s.completion_tokens + d.completion_tokens + r.completion_tokens + p.completion_tokens "
    "AS completion_tokens, s.ms + d.ms + r.ms + p.ms AS inference_ms FROM (SELECT DISTINCT incident_id "
    "FROM won WHERE agent <> 'unified') k "
    + " ".join(
        f"LEFT JOIN (SELECT * FROM won WHERE agent = '{a}') {a[0]} ON k.incident_id = {a[0]}.incident_id"
        for a in answers.CHAIN
    ),
)
check(
    "agent_chain",
    ["chains"],
    "SELECT incident_id, complete, agent_severity AS severity_detected, root_cause, confidence_score, "
    f"remediation_command, requires_human_approval, {_text('runbook_steps')} AS runbook_steps, summary "
    "FROM chains",
)
check(
    "usage_totals",
    ["chains"],
    "SELECT incident_id, prompt_tokens, completion_tokens, inference_ms FROM chains WHERE complete",
)
view("anchored", ["incidents"], "SELECT * FROM incidents WHERE coalesce(context, '') <> ''")
check(
    "unavailable",
    ["anchored", "chains"],
    "SELECT i.request_id AS incident_id, service_name, CASE WHEN c.incident_id IS NULL THEN 'severity' "
    f"ELSE missing_agent END AS missing_agent, {quoted(answers.UNAVAILABLE)} AS detail FROM anchored i "
    "LEFT JOIN chains c ON i.request_id = c.incident_id WHERE complete IS NOT TRUE",
)

# --- proposals of both kinds -------------------------------------------------

view(
    "proposals",
    ["commands", "parsed"],
    "SELECT 'remediation' AS kind, command_id AS proposal_id, remediation_command, command_type, "
    "requires_human_approval, runbook_steps FROM commands UNION ALL SELECT 'unified', incident_id * 10 + "
    "attempt, remediation_command, command_type, requires_human_approval, NULL FROM parsed WHERE agent = "
    "'unified' AND len(errors) = 0",
)
view("decided_both", ["proposals"], _decide("proposals", "kind, proposal_id"))
check("gov_unified", ["decided_both"], f"SELECT kind, proposal_id, {DECISION} FROM decided_both")

# --- prompts -----------------------------------------------------------------


def _prompt(agent: str, values: dict[str, str]) -> str:
    parts = []
    for literal, name in prompts.pieces(prompts.TEMPLATES[agent]):
        parts += [quoted(literal)] if literal else []
        parts += [values[name]] if name else []
    return " || ".join(parts)


_META = "'{\"service_name\": \"' || service_name || '\", \"environment\": \"' || environment || '\"}'"
_BASE = {"context": "context", "metadata": _META}
_CAUSE = {"root_cause": "root_cause", "explanation": "explanation"}
view(
    "asked",
    ["anchored", "chains"],
    "SELECT * FROM anchored i JOIN chains c ON i.request_id = c.incident_id",
)
for _agent in ("severity", "unified"):
    check(
        f"prompt_{_agent}",
        ["anchored"],
        f"SELECT request_id, {_prompt(_agent, _BASE)} AS prompt FROM anchored",
    )
check(
    "prompt_from_table",
    ["anchored"],
    f"SELECT request_id, CAST(request_id % 2 + 1 AS INTEGER) AS version, CASE request_id % 2 WHEN 0 THEN "
    f"{_prompt('severity', _BASE)} ELSE 'Service ' || service_name || ' in ' || environment || ' says:' || chr(10) || context "
    f"|| chr(10) || 'Is it fatal? ' || {_META} END AS prompt FROM anchored",
)
_HAVE = "agent_severity IS NOT NULL"
check(
    "prompt_diagnostic",
    ["asked"],
    f"SELECT request_id, {_prompt('diagnostic', _BASE | {'severity': 'agent_severity'})} AS prompt "
    f"FROM asked WHERE {_HAVE}",
)
_HAVE += " AND root_cause IS NOT NULL"
check(
    "prompt_remediation",
    ["asked"],
    f"SELECT request_id, {_prompt('remediation', _BASE | _CAUSE)} AS prompt FROM asked WHERE {_HAVE}",
)
_HAVE += " AND remediation_command IS NOT NULL"
_REVIEW = _CAUSE | {
    "context": "context",
    "service_name": "service_name",
    "environment": "environment",
    "severity": "agent_severity",
    "command": "CASE WHEN remediation_command = '' THEN 'None' ELSE remediation_command END",
}
check(
    "prompt_postmortem",
    ["asked"],
    f"SELECT request_id, {_prompt('postmortem', _REVIEW)} AS prompt FROM asked WHERE {_HAVE}",
)


def _json_text(column: str) -> str:
    """ASCII-only JSON text; the tables hold no character beyond 16 bits."""
    return (
        f"'\"' || array_to_string(list_transform(string_split({column}, ''), lambda c: CASE WHEN c = '\"' "
        "THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' "
        "WHEN c = chr(9) THEN '\\t' WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' WHEN "
        "unicode(c) BETWEEN 32 AND 126 THEN c ELSE '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') END), "
        "'') || '\"'"
    )


check(
    "metadata_json",
    [],
    f"SELECT conv_id, turn, '{{\"service_name\": ' || {_json_text('text')} || ', \"environment\": ' || "
    f"{_json_text('role')} || '}}' AS metadata FROM conversations",
)
view(
    "sized",
    ["anchored"],
    f"SELECT request_id AS incident_id, length({_prompt('severity', _BASE)}) AS n FROM anchored",
)
check(
    "agent_map",
    ["sized"],
    "SELECT incident_id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN n % 3 <> 0 THEN "
    "'{\"severity_detected\": \"ERROR\", \"severity_reasoning\": \"' || CAST(n AS VARCHAR) || '\"}' WHEN "
    "n % 9 <> 0 THEN 'length ' || CAST(n AS VARCHAR) END AS raw_answer, CASE WHEN n % 3 <> 0 THEN "
    "'primary' WHEN n % 9 <> 0 THEN 'fallback' END AS transport, CAST(CASE WHEN n % 3 <> 0 OR n % 9 = 0 "
    "THEN 0 ELSE 1 END AS BIGINT) AS reported_prompt_tokens, CASE WHEN n % 3 = 0 THEN "
    "'ConnectionError(''no route'')' END AS error FROM (SELECT incident_id, n, unnest(range(1, CASE WHEN "
    "n % 9 = 0 THEN 4 ELSE 2 END)) AS attempt FROM sized)",
)

# The four agents in turn, over the lengths of their prompts.
_FINE = "n % 7 <> 0 AND n % 5 <> 0"
_GIVEN = {
    "severity": "'\"severity_detected\": \"' || CASE n % 2 WHEN 1 THEN 'FATAL' ELSE 'ERROR' END || '\"'",
    "diagnostic": (
        "'\"root_cause\": \"cause ' || n || '\", \"confidence_score\": 0.5, \"explanation\": \"seen ' || n || '\"'"
    ),
    "remediation": (
        "'\"remediation_command\": \"df -h /' || n || '\", \"command_type\": \"shell\", "
        "\"requires_human_approval\": false'"
    ),
    "postmortem": "'\"summary\": \"review ' || n || '\"'",
}
_SAID = {
    "severity": "CASE n % 2 WHEN 1 THEN 'FATAL' ELSE 'ERROR' END AS said_severity",
    "diagnostic": "'cause ' || n AS said_cause, 'seen ' || n AS said_why",
    "remediation": "'df -h /' || n AS said_command",
}
_RUN_VALUES = _BASE | {
    "service_name": "service_name",
    "environment": "environment",
    "severity": "said_severity",
    "root_cause": "said_cause",
    "explanation": "said_why",
    "command": "said_command",
}
view("run_severity", ["anchored"], f"SELECT *, length({_prompt('severity', _RUN_VALUES)}) AS n FROM anchored")
for _before, _agent in zip(answers.CHAIN, answers.CHAIN[1:]):
    view(
        f"run_{_agent}",
        [f"run_{_before}"],
        f"SELECT * REPLACE (length({_prompt(_agent, _RUN_VALUES)}) AS n) FROM (SELECT *, {_SAID[_before]} "
        f"FROM run_{_before} WHERE {_FINE})",
    )
check(
    "agent_run",
    [f"run_{a}" for a in answers.CHAIN],
    " UNION ALL ".join(
        f"SELECT request_id AS incident_id, '{a}' AS agent, CAST(unnest(range(1, CASE WHEN {_FINE} THEN 2 "
        f"ELSE 4 END)) AS INTEGER) AS attempt, n AS prompt_length, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 "
        "THEN '{\"confidence_score\": \"high\", \"severity_detected\": 5, \"summary\": []}' ELSE "
        f"'{{' || {_GIVEN[a]} || '}}' END AS raw_answer, {_FINE} AS valid, CASE WHEN n % 7 = 0 THEN "
        f"'ConnectionError(''no route'')' END AS error FROM run_{a}"
        for a in answers.CHAIN
    ),
)

# --- reports -----------------------------------------------------------------

_ALL = (
    "incident_id, service_name, severity_detected, root_cause, confidence_score, explanation, command, "
    "decided_type, status, block_reason, steps, guardrail_triggered, matched_denylist_pattern, "
    "allowlist_verb, summary, contributing_factors, preventive_actions, impact_assessment, inference, "
    "total, prompt_tokens, completion_tokens"
)
_N = {name: quoted(text) for name, text in reports.NO_ANCHOR.items()}
view(
    "fixed_reports",
    ["incidents"],
    f"SELECT incident_key AS incident_id, service_name, {_N['severity_detected']} AS severity_detected, "
    f"{_N['root_cause']} AS root_cause, CAST(0 AS DOUBLE) AS confidence_score, {_N['explanation']} AS "
    "explanation, CAST(NULL AS VARCHAR) AS command, 'none' AS decided_type, 'APPROVED' AS status, "
    f"CAST(NULL AS VARCHAR) AS block_reason, {_N['runbook_step']} AS steps, false AS guardrail_triggered, "
    "CAST(NULL AS VARCHAR) AS matched_denylist_pattern, CAST(NULL AS VARCHAR) AS allowlist_verb, "
    f"{_N['summary']} AS summary, {_N['contributing_factor']} AS contributing_factors, "
    f"{_N['preventive_action']} AS preventive_actions, {_N['impact_assessment']} AS impact_assessment, "
    "CAST(0 AS DOUBLE) AS inference, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS prompt_tokens, "
    "CAST(0 AS BIGINT) AS completion_tokens FROM incidents WHERE coalesce(context, '') = ''",
)
view("complete", ["asked"], "SELECT * FROM asked WHERE complete")
view("complete_decided", ["complete"], _decide("complete", "request_id"))
view(
    "agent_reports",
    ["complete", "complete_decided"],
    "SELECT incident_key AS incident_id, service_name, agent_severity AS severity_detected, root_cause, "
    "confidence_score, explanation, command, decided_type, status, block_reason, steps, "
    "guardrail_triggered, matched_denylist_pattern, allowlist_verb, summary, "
    f"{_text('contributing_factors')} AS contributing_factors, {_text('preventive_actions')} AS "
    "preventive_actions, impact_assessment, round(inference_ms, 2) AS inference, CAST(0 AS DOUBLE) AS "
    "total, prompt_tokens, completion_tokens FROM complete c JOIN complete_decided d ON c.request_id = "
    "d.request_id",
)
view(
    "reports",
    ["fixed_reports", "agent_reports"],
    f"SELECT {_ALL} FROM fixed_reports UNION ALL SELECT {_ALL} FROM agent_reports",
)
check("report_no_anchor", ["fixed_reports"], f"SELECT {_ALL} FROM fixed_reports")
check("report_full", ["agent_reports"], f"SELECT {_ALL} FROM agent_reports")
check("report_all", ["reports"], f"SELECT {_ALL} FROM reports")
check("stream_triage", ["reports"], f"SELECT {_ALL} FROM reports")
_FLAWS = {"service_name": 5, "max_context_lines": 4}
view(
    "flawed",
    ["defaulted"],
    "SELECT CASE WHEN request_id % 10 = 3 THEN 'json' ELSE array_to_string(list_filter(["
    + ", ".join(
        f"CASE WHEN NOT ({test}){f' OR request_id % 10 = {_FLAWS[n]}' if n in _FLAWS else ''} THEN '{n}' END"
        for n, test in _REQUEST_TESTS.items()
    )
    + "], lambda x: x IS NOT NULL), '|') END AS errors FROM defaulted",
)
# Every line is there twice; rejected ones have keys of their own, accepted ones the key of their given id.
check(
    "stream_quarantine",
    ["flawed"],
    "SELECT errors, 2 * count(*) AS lines, CASE WHEN errors = '' THEN 1 ELSE 2 END * count(*) AS keys FROM flawed GROUP BY errors",
)
check(
    "stream_late_answers",
    ["checked", "incidents", "anchored", "chains", "reports"],
    "SELECT CAST(request_id AS VARCHAR) AS request_id, 'rejected' AS outcome, NULL AS missing_agent, NULL AS status FROM "
    "checked WHERE len(errors) > 0 UNION ALL SELECT CAST(i.request_id AS VARCHAR), CASE WHEN coalesce(context, '') = '' THEN "
    "'quiet' WHEN complete THEN 'complete' ELSE 'dead' END, CASE WHEN coalesce(context, '') = '' OR complete THEN NULL WHEN "
    "c.incident_id IS NULL THEN 'severity' ELSE missing_agent END, r.status FROM incidents i LEFT JOIN chains c ON "
    "i.request_id = c.incident_id LEFT JOIN reports r ON r.incident_id = i.incident_key",
)
_LIST = "CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({0}, '|') END"
check(
    "report_json",
    ["reports"],
    "SELECT incident_id, CAST(to_json(struct_pack(incident_id := incident_id, service_name := "
    "service_name, severity_detected := severity_detected, root_cause := root_cause, confidence_score := "
    "confidence_score, explanation := explanation, remediation := struct_pack(command := command, "
    "command_type := decided_type, status := status, block_reason := block_reason, runbook_steps := "
    f"{_LIST.format('steps')}), post_mortem := struct_pack(summary := summary, contributing_factors := "
    f"{_LIST.format('contributing_factors')}, preventive_actions := "
    f"{_LIST.format('preventive_actions')}, impact_assessment := impact_assessment), governance := "
    "struct_pack(guardrail_triggered := guardrail_triggered, matched_denylist_pattern := "
    "matched_denylist_pattern, allowlist_verb := allowlist_verb), timing_ms := struct_pack(preprocessing "
    ":= CAST(0 AS DOUBLE), inference := inference, governance := CAST(0 AS DOUBLE), total := total), "
    "token_usage := struct_pack(prompt_tokens := prompt_tokens, completion_tokens := completion_tokens))) "
    "AS VARCHAR) AS report FROM reports",
)
check(
    "escalations",
    ["reports"],
    "SELECT incident_id, service_name, block_reason, '[ESCALATION REQUIRED] Incident ID: ' || incident_id "
    "|| ' | Service: ' || service_name || ' | Reason: ' || block_reason AS message FROM reports WHERE "
    "status = 'BLOCKED_ESCALATED'",
)
check(
    "timing_block",
    [],
    "SELECT event_id, round(value / 7, 2) AS preprocessing, round(value / 3, 2) AS inference, "
    "round(value / 11, 2) AS governance, round(value, 2) AS total FROM events",
)

# --- metrics -----------------------------------------------------------------

view("responses", [], f"SELECT {_columns(inputs.metric_columns(CHECK))} FROM events")
view(
    "measured",
    ["responses"],
    "SELECT request_id, service, status_code, wall_ms, CASE WHEN status_code = 200 THEN "
    "CAST(json_extract_string(body, '$.timing_ms.total') AS DOUBLE) END AS server_total_ms, CASE WHEN "
    "status_code = 200 THEN CAST(json_extract_string(body, '$.token_usage.prompt_tokens') AS BIGINT) END "
    "AS prompt_tokens FROM responses",
)
check("metric_extract", ["measured"], "SELECT * FROM measured")
check(
    "metric_counts",
    ["measured"],
    "SELECT service, count(*) AS total, count(*) FILTER (status_code = 200) AS succeeded, count(*) "
    "FILTER (status_code <> 200) AS failed FROM measured GROUP BY service",
)
view(
    "ranked",
    ["measured"],
    "SELECT *, row_number() OVER (PARTITION BY service ORDER BY wall_ms) - 1 AS place, count(*) OVER "
    "(PARTITION BY service) AS n, row_number() OVER (ORDER BY wall_ms) - 1 AS place_all, count(*) OVER () "
    "AS n_all FROM measured WHERE status_code = 200",
)


def _percentiles(place: str, n: str, names: list[str]) -> str:
    return ", ".join(
        f"max(wall_ms) FILTER ({place} = least({n} - 1, CAST(floor({n} * CAST({metrics.PERCENTILES[p]} AS "
        f"DOUBLE)) AS BIGINT))) AS {p}"
        for p in names
    )


_NAMES = list(metrics.PERCENTILES)
check(
    "metric_percentiles",
    ["ranked"],
    f"SELECT service, count(*) AS succeeded, {_percentiles('place', 'n', _NAMES)} FROM ranked "
    "GROUP BY service",
)
check(
    "metric_percentiles_global",
    ["ranked"],
    f"SELECT count(*) AS succeeded, {_percentiles('place_all', 'n_all', _NAMES)} FROM ranked",
)
_MEANS = (
    "coalesce(CAST(sum(prompt_tokens) AS DOUBLE) / count(prompt_tokens), 0) AS mean_tokens, "
    "CAST(round_even(coalesce(CAST(sum(prompt_tokens) AS DOUBLE) / count(prompt_tokens), 0), 0) AS BIGINT) "
    "AS mean_tokens_rounded, coalesce(max(prompt_tokens), 0) AS max_tokens"
)
check(
    "metric_tokens",
    ["measured"],
    f"SELECT service, {_MEANS} FROM measured GROUP BY service",
)
check(
    "metric_verdicts",
    ["measured", "ranked"],
    "SELECT *, p95 < 1000 AS p95_under_limit, max_tokens < 3000 AS tokens_bounded FROM (SELECT "
    f"{_MEANS} FROM measured), (SELECT {_percentiles('place_all', 'n_all', ['p95'])} FROM ranked)",
)
