"""Checks of requests and agent answers: reasons per row, then keep or set aside.

A record is rejected as a whole when any field is wrong, so every check yields
``errors ARRAY<STRING>`` with the names of the wrong fields, and a record is
valid when that array is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.functions.rows import computed_once
from tocsin.functions.text import SPACES, sql_text


# --- requests ---------------------------------------------------------------


def with_default_window(requests: DataFrame) -> DataFrame:
    return requests.withColumn(
        "max_context_lines", F.coalesce("max_context_lines", F.lit(schemas.WINDOW_DEFAULT))
    )


def request_tests() -> dict[str, Column]:
    """What must hold of each field; lengths are in code points, limits inclusive."""
    return {
        "service_name": F.length("service_name").between(1, schemas.SERVICE_NAME_MAX),
        "environment": F.col("environment").isin(schemas.ENVIRONMENTS),
        "log_payload": F.length("log_payload").between(1, schemas.PAYLOAD_MAX),
        "max_context_lines": F.col("max_context_lines").between(
            schemas.WINDOW_MIN, schemas.WINDOW_MAX
        ),
    }


def check_requests(requests: DataFrame) -> DataFrame:
    """Adds ``errors``; a null field is wrong."""
    names = [
        F.when(F.coalesce(test, F.lit(False)), None).otherwise(F.lit(name))
        for name, test in request_tests().items()
    ]
    return requests.withColumn("errors", F.array_compact(F.array(*names)))


def accepted(requests: DataFrame) -> DataFrame:
    """Requests without errors, as plain predicates that reach the scan."""
    for test in request_tests().values():
        requests = requests.filter(test)
    return requests


def quarantined(checked: DataFrame) -> DataFrame:
    """One row per rejected record and reason, with the payload's size and hash in its place."""
    payload = F.col("log_payload")
    slim = checked.filter(F.size("errors") > 0).select(
        *[c for c in checked.columns if c != "log_payload"],
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
    )
    return slim.select(*[c for c in slim.columns if c != "errors"], F.explode("errors").alias("error"))


# --- agent answers ----------------------------------------------------------

TEXT, NUMBER, FLAG, TEXTS = "text", "number", "flag", "texts"


@dataclass(frozen=True)
class Field:
    """One field of an answer; ``default`` is used only where the key is absent."""

    name: str
    kind: str
    required: bool = True
    default: object = None
    longest: int | None = None
    allowed: tuple[str, ...] | None = None


_SEVERITY = Field("severity_detected", TEXT, allowed=tuple(schemas.SEVERITIES))
_DIAGNOSIS = [
    Field("root_cause", TEXT, longest=280),
    Field("confidence_score", NUMBER),
    Field("explanation", TEXT, longest=500),
]
_REMEDY = [
    Field("remediation_command", TEXT),
    Field("command_type", TEXT, allowed=tuple(schemas.COMMAND_TYPES)),
    Field("requires_human_approval", FLAG),
]

# What each agent must answer.
ANSWERS: dict[str, list[Field]] = {
    "severity": [
        _SEVERITY,
        Field(
            "severity_reasoning",
            TEXT,
            required=False,
            default="Standard severity classification from log signatures.",
            longest=500,
        ),
    ],
    "diagnostic": _DIAGNOSIS,
    "remediation": [*_REMEDY, Field("runbook_steps", TEXTS, required=False)],
    "postmortem": [
        Field("summary", TEXT, required=False, default="", longest=500),
        Field("contributing_factors", TEXTS, required=False),
        Field("preventive_actions", TEXTS, required=False),
        Field("impact_assessment", TEXT, required=False, default="", longest=500),
    ],
    "unified": [_SEVERITY, *_DIAGNOSIS, *_REMEDY],
}

# Texts read as a yes or a no, in any case.
YES = ["1", "on", "t", "true", "y", "yes"]
NO = ["0", "off", "f", "false", "n", "no"]
NUMBER_TEXT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

_END = "end of answer"


def parse_object(rows: DataFrame, text: str, name: str = "_parsed") -> DataFrame:
    """Add the JSON object in a text as VARIANT, null unless the text is exactly one.

    The parser by itself would ignore what follows a complete value.  The text
    is therefore read as the first element of an array that ends in a marker;
    ``part_of`` finds a field of that first element.
    """
    ended = F.concat(F.lit("["), F.col(text), F.lit(f', "{_END}"]'))
    listed = computed_once(
        rows, {name: F.when(F.col(text).startswith("{"), F.try_parse_json(ended))}
    )
    whole = F.try_variant_get(name, "$[1]", "string") == _END
    return computed_once(listed, {name: F.when(whole, F.col(name))})


def part_of(parsed: str, field: str) -> str:
    """SQL for a field of the object in a parsed column, as VARIANT."""
    return f"try_variant_get({parsed}, '$[0].{field}', 'variant')"


def as_text(value: str, kind: str) -> str:
    """SQL for the text in a VARIANT column, null where it is of another type."""
    return f"CASE WHEN {kind} = 'STRING' THEN try_variant_get({value}, '$', 'string') END"


def typed_value(field: Field, value: str, kind: str) -> str:
    """SQL for a value by the lax rules, from a VARIANT column and its type's name.

    Null where the value is of the wrong type, or absent though required.
    """
    text, number = (f"try_variant_get({value}, '$', '{t}')" for t in ("string", "double"))
    numeric = f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL'))"
    if field.kind == NUMBER:
        bare = f"btrim({text}, {sql_text(SPACES)})"
        return (
            f"CASE WHEN {kind} = 'STRING' THEN CASE WHEN {bare} RLIKE {sql_text(NUMBER_TEXT)} "
            f"THEN try_cast({bare} AS DOUBLE) END WHEN {numeric} OR {kind} = 'BOOLEAN' THEN {number} END"
        )
    if field.kind == FLAG:
        yes, no = (", ".join(map(sql_text, words)) for words in (YES, NO))
        return (
            f"CASE WHEN {kind} = 'BOOLEAN' THEN try_variant_get({value}, '$', 'boolean') "
            f"WHEN {kind} = 'STRING' THEN CASE WHEN lower({text}) IN ({yes}) THEN true "
            f"WHEN lower({text}) IN ({no}) THEN false END "
            f"WHEN {numeric} THEN CASE {number} WHEN 1 THEN true WHEN 0 THEN false END END"
        )
    if field.kind == TEXTS:
        items = f"try_variant_get({value}, '$', 'array<string>')"
        return (
            f"CASE WHEN {value} IS NULL THEN CAST(array() AS ARRAY<STRING>) "
            f"WHEN {kind} IN ('ARRAY<STRING>', 'ARRAY<VOID>') AND NOT exists({items}, x -> x IS NULL) "
            f"THEN {items} END"
        )
    if field.required:
        return as_text(value, kind)
    return f"CASE WHEN {value} IS NULL THEN {sql_text(field.default)} ELSE {as_text(value, kind)} END"


def wrong_name(field: Field) -> str:
    """SQL for the field's name where its value breaks the rule, else null."""
    bad = f"{field.name} IS NULL"
    if field.allowed:
        bad += f" OR {field.name} NOT IN ({', '.join(map(sql_text, field.allowed))})"
    if field.longest:
        bad += f" OR length({field.name}) > {field.longest}"
    if field.kind == NUMBER:
        bad += f" OR NOT {field.name} BETWEEN 0 AND 1"
    return f"CASE WHEN {bad} THEN '{field.name}' END"


def all_fields(agents: list[str]) -> list[Field]:
    """Every field some agent may answer, in order, each once."""
    return list({f.name: f for a in agents for f in ANSWERS[a]}.values())


def check_answers(
    answers: DataFrame, agents: list[str], text: str = "answer_text", agent: str = "agent"
) -> DataFrame:
    """Parse the cleaned answers, add typed fields and ``errors``.

    Every row is parsed once and read by its own agent's rules; fields the agent
    does not answer are null.  A text that is no JSON object has error ``json``.
    """
    fields = all_fields(agents)
    parsed = parse_object(computed_once(answers, {text: F.col(text)}), text)

    def mine(field: Field, sql: str) -> Column:
        """Only where an answer could be read, and by an agent that has the field."""
        owners = [sql_text(a) for a in agents if field in ANSWERS[a]]
        owned = "" if len(owners) == len(agents) else f" AND {agent} IN ({', '.join(owners)})"
        return F.expr(f"CASE WHEN _parsed IS NOT NULL{owned} THEN {sql} END")

    parts = computed_once(parsed, {f"_v_{f.name}": mine(f, part_of("_parsed", f.name)) for f in fields})
    kinds = computed_once(
        parts, {f"_k_{f.name}": F.expr(f"schema_of_variant(_v_{f.name})") for f in fields}
    )
    values = {f.name: mine(f, typed_value(f, f"_v_{f.name}", f"_k_{f.name}")) for f in fields}
    typed = computed_once(kinds, values)
    by_agent = " ".join(
        f"WHEN {sql_text(a)} THEN array_compact(array({', '.join(map(wrong_name, ANSWERS[a]))}))"
        for a in agents
    )
    errors = f"CASE WHEN _parsed IS NULL THEN array('json') ELSE CASE {agent} {by_agent} END END"
    judged = computed_once(typed, {"errors": F.expr(errors)})
    return judged.select(*answers.columns, *values, "errors")
