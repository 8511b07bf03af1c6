"""Inputs derived from the given tables.

The tables hold no incident dumps, commands or agent answers, so these views
make them from every row of ``documents`` and ``events``.  Each view is defined
once, as SQL expressions that both Spark and the check database read; the two
dialects differ only in a few spellings (``Dialect``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.functions.rows import computed_once
from tocsin.operators.logs import number_lines


@dataclass(frozen=True)
class Dialect:
    """Spellings that differ between the two SQL dialects."""

    name: str

    def whole(self, a: str, b: int) -> str:
        return f"{a} div {b}" if self.name == "spark" else f"{a} // {b}"

    def texts(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"

    def pick(self, index: str, items: list[str]) -> str:
        """The item at a 0-based index that is known to be in range."""
        if self.name == "spark":
            return f"element_at({self.texts(*items)}, CAST({index} + 1 AS INT))"
        return f"list_extract({self.texts(*items)}, {index} + 1)"

    def map_lines(self, text: str, body: str) -> str:
        """Map the LF-separated lines of a text; ``body`` uses line and i (from 0)."""
        if self.name == "spark":
            return f"transform(split({text}, '\\\\n'), (line, i) -> {body})"
        shifted = body.replace("{i}", "(i - 1)")
        return f"list_transform(string_split({text}, chr(10)), lambda line, i: {shifted})"

    def join_lines(self, lines: str, separator: str) -> str:
        """Join lines that hold no LF; the separator may be a column."""
        if self.name == "spark":
            return f"array_join({lines}, {separator})"
        return f"replace(array_to_string({lines}, chr(10)), chr(10), {separator})"

    def props_number(self) -> str:
        """The number in props, which reads {"k": n}."""
        if self.name == "spark":
            return "CAST(get_json_object(props, '$.k') AS BIGINT)"
        return "CAST(json_extract_string(props, '$.k') AS BIGINT)"


SPARK, CHECK = Dialect("spark"), Dialect("check")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- requests: every document is one dump -----------------------------------

# Line starts by (doc_id * 31 + line * 17) % 53; the rest of the codes are INFO.
# The last three only look like severity words and are noise.
LINE_STARTS = {
    0: "FATAL",
    1: "[ERROR]",
    2: "Exception:",
    3: "traceback",
    4: "Panic!",
    5: "WARN",
    6: "DEBUG",
    7: "ERROR_CODE=7",
    8: "IOException",
    9: "kernelpanic",
}


def request_columns(d: Dialect) -> dict[str, str]:
    code = "(doc_id * 31 + {i} * 17) % 53"
    start = " ".join(f"WHEN {n} THEN '{word}'" for n, word in LINE_STARTS.items())
    body = f"concat(CASE {code} {start} ELSE 'INFO' END, ' ', line)"
    lines = d.map_lines("text", body if d is CHECK else body.replace("{i}", "i"))
    breaks = ["chr(10)", "concat(chr(13), chr(10))", "chr(13)", "chr(12)", "chr(10)"]
    separator = d.pick("doc_id % 5", breaks)
    return {
        "request_id": "doc_id",
        "service_name": (
            "CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 43 = 0 THEN repeat('s', 129) "
            "ELSE concat(source, '-', lang) END"
        ),
        "environment": (
            "CASE WHEN doc_id % 37 = 5 THEN 'qa' WHEN doc_id % 37 = 6 THEN 'Prod' "
            "WHEN doc_id % 3 = 0 THEN 'prod' WHEN doc_id % 3 = 1 THEN 'staging' ELSE 'dev' END"
        ),
        "log_payload": (
            f"CASE WHEN doc_id % 47 = 7 THEN '' ELSE concat({d.join_lines(lines, separator)}, "
            f"CASE WHEN doc_id % 4 = 0 THEN {separator} ELSE '' END) END"
        ),
        "max_context_lines": (
            "CASE WHEN doc_id % 29 = 0 THEN 0 WHEN doc_id % 29 = 1 THEN 51 "
            "WHEN doc_id % 29 = 2 THEN NULL ELSE doc_id % 13 + 1 END"
        ),
    }


# Requests whose dumps make one log file.
DUMPS_PER_FILE = 20

# A second version of a template.
OTHER_SEVERITY = "Service {service_name} in {environment} says:\n{context}\nIs it fatal? {metadata}"

# --- log lines: every event is one line of its user's incident --------------

LEVEL = (
    "CASE WHEN event_type = 'error' AND value >= 100 THEN 'FATAL' WHEN event_type = 'error' "
    "THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN' ELSE 'INFO' END"
)


def line_columns(d: Dialect) -> dict[str, str]:
    day = "dayofmonth(ts)" if d is SPARK else "day(ts)"
    return {
        "incident_id": f"user_id * 10 + {d.whole(f'({day} - 1)', 5)}",
        "ts": "ts",
        "event_id": "event_id",
        "raw": (
            f"concat({LEVEL}, ' svc-', CAST(user_id % 7 AS VARCHAR(20)), ' ', event_type, ' ', "
            "CAST(event_id AS VARCHAR(20)))"
        ),
    }


# Window size of an incident of the line table.
LINE_WINDOW = "incident_id % 6 + 1"

# --- commands: every event proposes one command -----------------------------

# (command with {u} for the user id, command type)
CATALOGUE = [
    ("kubectl rollout restart statefulset/q{u}", "kubectl"),
    ("kubectl scale deployment/web-{u} --replicas=3", "kubectl"),
    ("kubectl describe node n{u}", "kubectl"),
    ("kubectl rollout status deployment/web-{u}", "kubectl"),
    ("kubectl getx pods", "kubectl"),
    ("kubectl delete ns team-{u}", "kubectl"),
    ("kubectl delete persistentvolume vol-{u}", "kubectl"),
    ("kubectl delete pod web-{u}", "kubectl"),
    ("systemctl restart worker-{u}", "shell"),
    ("journalctl -u worker-{u} --since today", "shell"),
    ("df -h /srv/{u}", "shell"),
    ("tail -n 200 /srv/{u}/app.out", "shell"),
    ("rm -rf /srv/{u}/cache", "shell"),
    ("RM   -RF /srv/{u}", "shell"),
    ("rm -fr /srv/{u}", "shell"),
    ("mkfs.xfs /dev/sd{u}", "shell"),
    ("dd  if=image{u} of=copy{u}", "shell"),
    ("sudo shutdown -r +{u}", "shell"),
    ("systemctl status worker-{u} && reboot", "shell"),
    ("init 0", "shell"),
    (":(){ :|:& };:", "shell"),
    ("chmod -R 777 /srv/{u}", "shell"),
    ("chown -R app:app /srv /", "shell"),
    ("docker system prune -a -f", "shell"),
    ("terraform destroy -target=web{u}", "shell"),
    ("iptables -F", "shell"),
    ("ufw disable", "shell"),
    ("bash /srv/{u}/repair.sh", "shell"),
    ("SELECT max(a) FROM t{u}", "sql"),
    ("select 1", "sql"),
    ("EXPLAIN SELECT * FROM t{u}", "sql"),
    ("DROP TABLE t{u}", "sql"),
    ("drop schema s{u}", "sql"),
    ("TRUNCATE t{u}", "sql"),
    ("DELETE FROM t{u}_old", "sql"),
    ("DELETE FROM t{u} WHERE a = 1", "sql"),
    ("DELETE FROM t WHERE id = {u}", "sql"),
    ("UPDATE t SET a = {u}", "sql"),
    ("GET /status/{u}", "http"),
    ("POST /restart-worker?id={u}", "http"),
    ("GETX /status", "http"),
    ("DELETE /worker/{u}", "http"),
    ("rm -rf /srv/{u}", "none"),
    ("", "shell"),
    ("   ", "sql"),
    ("kubectl get pods", "shell"),
    ("helm list", "helm"),
]


# Rules of the large tables: each names a number that some commands hold.
LARGE_DENY, LARGE_ALLOW = 5_000, 50_000


def large_rules(deny: list[str], allow: dict[str, list[str]]) -> tuple[list[str], dict[str, list[str]]]:
    """The given rules, and so many more that there are ``LARGE_DENY`` patterns and ``LARGE_ALLOW`` prefixes."""
    more = [rf"\bworker-{n}\b" for n in range(LARGE_DENY - len(deny))]
    known = sum(map(len, allow.values()))
    paths = [f"bash /srv/{n}/" for n in range(LARGE_ALLOW - known)]
    return deny + more, allow | {"shell": allow["shell"] + paths}


def command_columns(d: Dialect) -> dict[str, str]:
    n = len(CATALOGUE)
    text = d.pick(f"event_id % {n}", [quoted(c) for c, _ in CATALOGUE])
    command = f"replace({text}, '{{u}}', CAST(user_id AS VARCHAR(20)))"
    turn = f"({d.whole('event_id', n)})"
    return {
        "command_id": "event_id",
        "service_name": "concat('svc-', CAST(user_id % 7 AS VARCHAR(20)))",
        "remediation_command": (
            f"CASE WHEN {turn} % 11 = 10 THEN NULL WHEN {turn} % 4 = 1 "
            f"THEN concat(chr(9), {command}, chr(28), chr(10)) ELSE {command} END"
        ),
        "command_type": d.pick(f"event_id % {n}", [quoted(t) for _, t in CATALOGUE]),
        "requires_human_approval": f"{turn} % 5 = 3",
        "runbook_steps": (
            f"CASE WHEN event_type = 'view' THEN NULL ELSE {d.texts(quoted('check'), 'event_type')} END"
        ),
    }


# --- answers: every event is one attempt of one agent on one incident -------

AGENT_NAMES = ["severity", "diagnostic", "remediation", "postmortem", "unified"]


def answer_columns(d: Dialect) -> dict[str, str]:
    """JSON answers, most of them good; ``value`` and ``props`` choose the flaw."""
    user = "CAST(user_id AS VARCHAR(20))"
    k = d.props_number()
    # Confidence as text: 0.00 to 0.99, out of range, a numeric string, a word.
    share = f"concat('0.', lpad(CAST({k} % 100 AS VARCHAR(20)), 2, '0'))"
    confidence = (
        f"CASE flaw WHEN 1 THEN '1.5' WHEN 2 THEN concat('\"', {share}, '\"') "
        f"WHEN 3 THEN '\"high\"' WHEN 4 THEN 'true' ELSE {share} END"
    )
    severity = "CASE WHEN flaw = 5 THEN 'WARN' WHEN user_id % 3 = 0 THEN 'FATAL' ELSE 'ERROR' END"
    cause = (
        "CASE WHEN flaw = 6 THEN concat('\"', repeat('long ', 57), '\"') "
        f"WHEN flaw = 7 THEN '17' ELSE concat('\"pool exhausted for user ', {user}, '\"') END"
    )
    explanation = f"concat('\"', event_type, ' seen by \\u0041 ', {user}, '\"')"
    if d is SPARK:
        explanation = explanation.replace("\\", "\\\\")
    approval = (
        "CASE WHEN flaw = 1 THEN '\"yes\"' WHEN flaw = 2 THEN '1' WHEN flaw = 3 THEN '2' "
        "WHEN flaw = 4 THEN '\"Off\"' WHEN flaw = 5 THEN 'null' WHEN user_id % 4 = 0 THEN 'true' "
        "ELSE 'false' END"
    )
    steps = (
        "CASE WHEN flaw = 6 THEN '[\"one\", 2]' WHEN flaw = 7 THEN '[]' WHEN flaw = 8 THEN '[null]' "
        "WHEN flaw = 9 THEN 'null' ELSE '[\"look\", \"act\"]' END"
    )
    n = len(CATALOGUE)
    turn = f"({d.whole('event_id', 15)} + user_id) % {n}"
    command = (
        f"replace({d.pick(turn, [quoted(c) for c, _ in CATALOGUE])}, '{{u}}', {user})"
    )
    kind = d.pick(turn, [quoted(t) for _, t in CATALOGUE])
    objects = {
        "severity": (
            f"concat('{{\"severity_detected\": \"', {severity}, '\"', CASE WHEN flaw = 6 THEN "
            "concat(', \"severity_reasoning\": \"', repeat('r', 501), '\"') WHEN flaw = 7 THEN '' "
            "ELSE concat(', \"severity_reasoning\": \"', event_type, '\"') END, '}')"
        ),
        "diagnostic": (
            f"concat('{{\"root_cause\": ', {cause}, ', \"confidence_score\": ', {confidence}, "
            f"CASE WHEN flaw = 8 THEN '' ELSE concat(', \"explanation\": ', {explanation}) END, "
            "', \"extra\": {\"a\": [1]}}')"
        ),
        "remediation": (
            f"concat('{{\"remediation_command\": \"', proposed, '\", \"command_type\": \"', proposed_type, "
            f"'\", \"requires_human_approval\": ', {approval}, CASE WHEN user_id % 5 = 0 THEN '' ELSE "
            f"concat(', \"runbook_steps\": ', {steps}) END, '}}')"
        ),
        "postmortem": (
            f"concat('{{\"summary\": ', CASE WHEN flaw = 1 THEN concat('\"', repeat('s', 501), '\"') "
            f"WHEN flaw = 2 THEN '3' ELSE concat('\"incident of ', {user}, '\"') END, "
            f"', \"contributing_factors\": ', {steps}, CASE WHEN flaw = 3 THEN '' ELSE "
            "', \"impact_assessment\": \"small\"' END, '}')"
        ),
        "unified": (
            f"concat('{{\"severity_detected\": \"', {severity}, '\", \"root_cause\": ', {cause}, "
            f"', \"confidence_score\": ', {confidence}, ', \"explanation\": ', {explanation}, "
            f"', \"remediation_command\": \"', proposed, '\", \"command_type\": \"', proposed_type, "
            f"'\", \"requires_human_approval\": ', {approval}, '}}')"
        ),
    }
    body = "CASE event_id % 5 " + " ".join(
        f"WHEN {n} THEN {objects[name]}" for n, name in enumerate(AGENT_NAMES)
    ) + " END"
    wrapped = (
        "CASE wrapping WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') "
        "WHEN 2 THEN concat(chr(10), '```', body, '```  ') WHEN 3 THEN concat('```json```', body) "
        "WHEN 4 THEN concat('Here it is: ', body) WHEN 5 THEN concat(body, ' ', body) "
        "WHEN 6 THEN concat('[', body, ']') ELSE body END"
    )
    return {
        "flaw": f"{k} % 25",
        "proposed": command,
        "proposed_type": kind,
        "wrapping": f"({k} + user_id) % 17",
        "body": body,
        "answer": wrapped,
        "incident_id": d.whole("event_id", 15),
        "agent": d.pick("event_id % 5", [quoted(a) for a in AGENT_NAMES]),
        "attempt": (
            f"CAST({d.whole('event_id', 5)} % 3 + 1 + CASE WHEN user_id % 19 = 0 THEN 3 ELSE 0 END "
            "AS INT)"
        ),
        "prompt": "concat('Explain ', event_type, ' ', props)",
        "primary_text": (
            "CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN '' "
            "WHEN event_type = 'signup' AND user_id % 6 = 0 THEN '   ' ELSE answer END"
        ),
        "primary_prompt_tokens": f"CASE WHEN event_type = 'purchase' THEN 0 ELSE {k} END",
        "primary_completion_tokens": f"CASE WHEN event_type = 'purchase' THEN 0 ELSE {k} % 7 END",
        "fallback_text": "CASE WHEN user_id % 13 = 0 THEN NULL ELSE answer END",
        "fallback_prompt_tokens": f"CASE WHEN user_id % 2 = 0 THEN {k} + 100 END",
        "fallback_completion_tokens": f"CASE WHEN user_id % 2 = 0 THEN {k} % 3 END",
        "ms": "value",
    }


ANSWER_STEPS = [["flaw", "wrapping", "proposed", "proposed_type"], ["body"], ["answer"]]

# --- request metrics: every event is one finished request -------------------


def metric_columns(d: Dialect) -> dict[str, str]:
    number = "format_string" if d is SPARK else "printf"
    k = d.props_number()
    return {
        "request_id": "event_id",
        "service": "concat('svc-', CAST(user_id % 7 AS VARCHAR(20)))",
        "status_code": "CASE WHEN event_type = 'error' THEN 503 ELSE 200 END",
        "wall_ms": "value",
        "body": (
            f"CASE WHEN event_type = 'view' THEN '{{}}' ELSE concat('{{\"timing_ms\": {{\"total\": ', "
            f"{number}('%.2f', value), '}}, \"token_usage\": {{\"prompt_tokens\": ', "
            f"CAST({k} AS VARCHAR(20)), '}}}}') END"
        ),
    }


# --- the views in Spark -----------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _select(source: DataFrame, columns: dict[str, str]) -> DataFrame:
    return source.selectExpr(*(f"{sql} AS {name}" for name, sql in columns.items()))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The payload is made once per row, as if it were stored."""
    columns = request_columns(SPARK)
    source = table(spark, folder, "documents")
    made = computed_once(source, {"log_payload": F.expr(columns["log_payload"])})
    return _select(made, columns | {"log_payload": "log_payload"})


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their time but without a number."""
    return _select(table(spark, folder, "events"), line_columns(SPARK))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return number_lines(raw_lines(spark, folder), "incident_id", "ts", "event_id").select(
        "incident_id", "line_no", "raw"
    )


def commands(spark: SparkSession, folder: str) -> DataFrame:
    return _select(table(spark, folder, "events"), command_columns(SPARK))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return answers_of(table(spark, folder, "events"))


def answers_of(source: DataFrame) -> DataFrame:
    """The answer text is made once per row, as if it were stored."""
    columns = answer_columns(SPARK)
    for step in ANSWER_STEPS:
        source = computed_once(source, {name: F.expr(columns.pop(name)) for name in step})
    return _select(source, columns)


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _select(table(spark, folder, "events"), metric_columns(SPARK))
