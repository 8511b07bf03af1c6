"""Prompts as projections over incident columns.

Templates are data: a body per agent with placeholders in braces.  A single body
is cut at its placeholders once, on the driver, and becomes one ``concat`` of
literals and columns.  A table of templates, in several versions, is compiled
to pieces as rows and joined by agent and version.  Either way text that
arrives in a column is never expanded again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.functions.text import json_quote

_ANSWER = "Answer with one JSON object and nothing around it. Fields:\n"
_LOGS = "\n\nLog excerpt:\n{context}"
_ORIGIN = "\n\nOrigin:\n{metadata}"

TEMPLATES = {
    "severity": (
        "Grade the incident shown in the log excerpt below.\n"
        + _ANSWER
        + '- "severity_detected": "FATAL" or "ERROR"\n'
        '- "severity_reasoning": why, in at most 500 characters' + _LOGS + _ORIGIN
    ),
    "diagnostic": (
        "Name the most likely root cause of a {severity} incident, using only the excerpt.\n"
        'Where the excerpt is too thin, start the cause with "Insufficient context:" and keep '
        "the confidence below 0.4.\n"
        + _ANSWER
        + '- "root_cause": one sentence of at most 280 characters\n'
        '- "confidence_score": a number from 0 to 1\n'
        '- "explanation": at most 500 characters, quoting lines' + _LOGS + _ORIGIN
    ),
    "remediation": (
        "Propose one safe command for the cause below, and the steps around it.\n"
        "Never wipe, drop, truncate, format, shut down or open up anything; where only that "
        "would help, look instead and ask for approval.\n"
        + _ANSWER
        + '- "remediation_command": one command, or "" without a type\n'
        '- "command_type": "shell", "kubectl", "sql", "http" or "none"\n'
        '- "requires_human_approval": true or false\n'
        '- "runbook_steps": a list of texts'
        "\n\nCause: {root_cause}\nWhy: {explanation}" + _LOGS + _ORIGIN
    ),
    "postmortem": (
        "Write a blameless review of the incident below.\n"
        + _ANSWER
        + '- "summary": at most 500 characters\n'
        '- "contributing_factors": a list of texts\n'
        '- "preventive_actions": a list of texts\n'
        '- "impact_assessment": at most 500 characters'
        "\n\nService {service_name} in {environment}, graded {severity}"
        "\nCause: {root_cause}\nWhy: {explanation}\nCommand: {command}" + _LOGS
    ),
    "unified": (
        "Diagnose the incident in the log excerpt and propose one safe command.\n"
        + _ANSWER
        + '- "severity_detected", "root_cause", "confidence_score", "explanation"\n'
        '- "remediation_command", "command_type", "requires_human_approval"' + _LOGS + _ORIGIN
    ),
}


def pieces(body: str) -> list[tuple[str, str | None]]:
    """Literal text and the placeholder after it, in order."""
    parts = re.split(r"\{(\w+)\}", body)
    return list(zip(parts[::2], parts[1::2] + [None]))


def fill(body: str, values: dict[str, Column]) -> Column:
    columns = []
    for literal, name in pieces(body):
        if literal:
            columns.append(F.lit(literal))
        if name:
            columns.append(values[name])
    return F.concat(*columns)


def metadata_json(service: Column, environment: Column) -> Column:
    """The incident's origin as JSON text, spaced after separators, ASCII only."""

    def value(column: Column) -> Column:
        return F.coalesce(json_quote(column), F.lit("null"))

    return F.concat(
        F.lit('{"service_name": '),
        value(service),
        F.lit(', "environment": '),
        value(environment),
        F.lit("}"),
    )


def _origin() -> Column:
    return metadata_json(F.col("service_name"), F.col("environment"))


def severity_prompt(body: str = TEMPLATES["severity"]) -> Column:
    return fill(body, {"context": F.col("context"), "metadata": _origin()})


def unified_prompt(body: str = TEMPLATES["unified"]) -> Column:
    return fill(body, {"context": F.col("context"), "metadata": _origin()})


def diagnostic_prompt(severity: Column | None = None, body: str = TEMPLATES["diagnostic"]) -> Column:
    """``severity`` is the severity agent's; FATAL where there is none."""
    graded = F.coalesce(severity, F.lit("FATAL")) if severity is not None else F.lit("FATAL")
    return fill(body, {"severity": graded, "context": F.col("context"), "metadata": _origin()})


def remediation_prompt(
    root_cause: Column, explanation: Column, body: str = TEMPLATES["remediation"]
) -> Column:
    return fill(
        body,
        {
            "root_cause": root_cause,
            "explanation": explanation,
            "context": F.col("context"),
            "metadata": _origin(),
        },
    )


def postmortem_prompt(
    severity: Column,
    root_cause: Column,
    explanation: Column,
    command: Column,
    body: str = TEMPLATES["postmortem"],
) -> Column:
    """Unknown origin reads ``unknown`` and an empty command reads ``None``."""
    return fill(
        body,
        {
            "service_name": F.coalesce("service_name", F.lit("unknown")),
            "environment": F.coalesce("environment", F.lit("unknown")),
            "severity": severity,
            "root_cause": root_cause,
            "explanation": explanation,
            "command": F.coalesce(F.nullif(command, F.lit("")), F.lit("None")),
            "context": F.col("context"),
        },
    )


# --- templates as a table ----------------------------------------------------

PLACEHOLDER = r"\{([A-Za-z0-9_]+)\}"
_ASKED = ["context", "metadata", "service_name", "environment"]
# Names that a template of each agent may quote.
QUOTABLE = {
    "severity": _ASKED,
    "diagnostic": [*_ASKED, "severity"],
    "remediation": [*_ASKED, "severity", "root_cause", "explanation"],
    "postmortem": [*_ASKED, "severity", "root_cause", "explanation", "command"],
    "unified": _ASKED,
}


def template_rows(spark: SparkSession, bodies: dict[str, str] | None = None, version: int = 1) -> DataFrame:
    """agent, version, body: one version of some agents' templates."""
    rows = [(agent, version, body) for agent, body in (bodies or TEMPLATES).items()]
    return spark.createDataFrame(rows, schemas.TEMPLATE)


def compiled(templates: DataFrame) -> DataFrame:
    """agent, version and pieces (text, and the name that follows it, null at the end) of every template.

    A table is refused as a whole, by an error that names the row, for an
    unknown agent, an absent version or body, a name that the agent's templates
    may not quote, or a version that an agent has twice.
    """
    allowed = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in QUOTABLE.items() for x in kv))
    texts, names = F.split("body", PLACEHOLDER, -1), F.regexp_extract_all("body", F.lit(PLACEHOLDER), F.lit(1))
    told = templates.groupBy("agent", "version").agg(F.min("body").alias("body"), F.count("*").alias("_rows"))
    told = told.withColumns({"_names": names, "_texts": texts, "_allowed": F.try_element_at(allowed, F.col("agent"))})
    fault = (
        F.when(F.col("_allowed").isNull(), "unknown agent")
        .when(F.col("version").isNull() | F.col("body").isNull(), "version or body is absent")
        .when(F.col("_rows") > 1, "version occurs twice")
        .when(F.size(F.array_except("_names", "_allowed")) > 0, "placeholder the agent has no value for")
    )
    where = F.concat(F.coalesce("agent", F.lit("?")), F.lit(" "), F.coalesce(F.col("version").cast("string"), F.lit("?")))
    pieces_of = F.transform("_texts", lambda t, i: F.struct(t.alias("text"), F.get("_names", i).alias("name")))
    checked = F.when(fault.isNull(), pieces_of).otherwise(F.raise_error(F.concat(F.lit("template "), where, F.lit(": "), fault)))
    return told.select("agent", "version", checked.alias("pieces"))


def newest(templates: DataFrame) -> DataFrame:
    """Each agent's template of the highest version."""
    return templates.groupBy("agent").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"))


def prompts_from_table(
    asked: DataFrame, templates: DataFrame, agent: str, values: dict[str, Column], version: Column | None = None
) -> DataFrame:
    """Add ``prompt`` from the agent's template of each row's ``version``, by default the newest.

    ``values`` gives a column for every name that the templates quote; as in a
    single body, a null value makes the prompt null.  A row whose version the
    table does not have has a null prompt.
    """
    own = templates if version is not None else newest(templates)
    table = compiled(own).filter(F.col("agent") == agent).select(F.col("version").alias("_version"), "pieces")
    wanted = asked.withColumn("_wanted", version.cast("int") if version is not None else table.select(F.max("_version")).scalar())
    given = F.create_map(*(x for name, column in values.items() for x in (F.lit(name), column.cast("string"))))
    rows = wanted.withColumn("_given", given).join(table, F.col("_wanted") == F.col("_version"), "left")

    def spelt(piece: Column) -> Column:
        return F.when(piece["name"].isNull(), piece["text"]).otherwise(
            F.concat(piece["text"], F.try_element_at("_given", piece["name"]))
        )

    parts = F.transform("pieces", spelt)
    prompt = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    return rows.withColumn("prompt", prompt).drop("_wanted", "_given", "_version", "pieces")


def asked_values() -> dict[str, Column]:
    """Values that every agent's templates may quote, as columns of incidents."""
    return {
        "context": F.col("context"),
        "metadata": _origin(),
        "service_name": F.coalesce("service_name", F.lit("unknown")),
        "environment": F.coalesce("environment", F.lit("unknown")),
    }
