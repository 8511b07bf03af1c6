"""Incident reports: fixed ones without an anchor, full ones from the agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.functions.rounding import round_cents
from tocsin.operators.answers import is_complete, usage_of_chain
from tocsin.operators.governance import Rules, decide

# The report of a dump without an anchor, the escalation message
# and its reason where none is given.
NO_ANCHOR = {
    "severity_detected": "ERROR",
    "root_cause": "No FATAL or ERROR signatures detected in input logs.",
    "explanation": (
        "Deterministic preprocessor scanned log payload and found no fatal or error anchors."
    ),
    "runbook_step": (
        "No action required. All system metrics and log anchors report normal operational state."
    ),
    "summary": "No error anchor identified.",
    "contributing_factor": "Input log dump did not match error/fatal criteria.",
    "preventive_action": "Maintain normal operational logging.",
    "impact_assessment": "Zero impact detected.",
}
ESCALATION = "[ESCALATION REQUIRED] Incident ID: %s | Service: %s | Reason: %s"
DEFAULT_REASON = "Guardrail triggered"

TIMINGS = ["preprocessing", "inference", "governance", "total"]


def incident_key(*parts: Column) -> Column:
    """A UUID-shaped key from the input, so that a rerun gives the same key."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(digest, start, length) for start, length in cuts))


def request_key() -> Column:
    return incident_key(*(F.col(c) for c in ("request_id", "service_name", "environment")))


def timing_block(
    preprocessing: Column, inference: Column, governance: Column, total: Column
) -> Column:
    """The four supplied times, each rounded to two decimals."""
    values = F.array(*(v.cast("double") for v in (preprocessing, inference, governance, total)))
    rounded = F.transform(values, round_cents)
    return F.struct(*(rounded[i].alias(n) for i, n in enumerate(TIMINGS)))


def has_anchor() -> Column:
    """Empty context counts as none."""
    return (F.coalesce("context", F.lit("")) != "") & F.col("severity").isNotNull()


def _texts(*items: str) -> Column:
    return F.array(*(F.lit(i) for i in items)) if items else F.array().cast("array<string>")


def _typed(columns: dict[str, Column]) -> list[Column]:
    return [columns[f.name].cast(f.dataType).alias(f.name) for f in schemas.REPORT.fields]


def _fixed_report() -> dict[str, Column]:
    null, zero = F.lit(None), F.lit(0.0)
    return {
        "incident_id": F.col("incident_key"),
        "service_name": F.col("service_name"),
        "severity_detected": F.lit(NO_ANCHOR["severity_detected"]),
        "root_cause": F.lit(NO_ANCHOR["root_cause"]),
        "confidence_score": zero,
        "explanation": F.lit(NO_ANCHOR["explanation"]),
        "remediation": F.struct(
            null.alias("command"),
            F.lit("none").alias("command_type"),
            F.lit(schemas.APPROVED).alias("status"),
            null.alias("block_reason"),
            _texts(NO_ANCHOR["runbook_step"]).alias("runbook_steps"),
        ),
        "post_mortem": F.struct(
            F.lit(NO_ANCHOR["summary"]).alias("summary"),
            _texts(NO_ANCHOR["contributing_factor"]).alias("contributing_factors"),
            _texts(NO_ANCHOR["preventive_action"]).alias("preventive_actions"),
            F.lit(NO_ANCHOR["impact_assessment"]).alias("impact_assessment"),
        ),
        "governance": F.struct(
            F.lit(False).alias("guardrail_triggered"),
            null.alias("matched_denylist_pattern"),
            null.alias("allowlist_verb"),
        ),
        "timing_ms": timing_block(_time("preprocessing_ms"), zero, zero, _time("total_ms")),
        "token_usage": F.struct(F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens")),
    }


def _agent_report() -> dict[str, Column]:
    return {
        "incident_id": F.col("incident_key"),
        "service_name": F.col("service_name"),
        "severity_detected": F.col("agent_severity.severity_detected"),
        "root_cause": F.col("diagnostic.root_cause"),
        "confidence_score": F.col("diagnostic.confidence_score"),
        "explanation": F.col("diagnostic.explanation"),
        "remediation": F.col("decided_remediation"),
        "post_mortem": F.struct(*(F.col(f"postmortem.{f.name}") for f in schemas.POST_MORTEM.fields)),
        "governance": F.col("decided_governance"),
        "timing_ms": timing_block(
            _time("preprocessing_ms"), F.col("inference_ms"), _time("governance_ms"), _time("total_ms")
        ),
        "token_usage": F.struct(F.col("prompt_tokens"), F.col("completion_tokens")),
    }


def _time(name: str) -> Column:
    """Times are measured outside the plan and come as columns, 0 where unknown."""
    return F.coalesce(name, F.lit(0.0))


def _with_times(incidents: DataFrame) -> DataFrame:
    absent = [n for n in ("preprocessing_ms", "governance_ms", "total_ms") if n not in incidents.columns]
    return incidents.withColumns({n: F.lit(None).cast("double") for n in absent})


def no_anchor_reports(incidents: DataFrame) -> DataFrame:
    """Fixed reports for the incidents in whose dump nothing was found."""
    return _with_times(incidents).filter(~has_anchor()).select(*_typed(_fixed_report()))


def joined_chains(incidents: DataFrame, chains: DataFrame, rules: Rules, how: str) -> DataFrame:
    """Incidents with their chain, the governance decision and the usage totals."""
    usage = {n: F.when(F.col("_complete"), c) for n, c in usage_of_chain().items()}
    chain_rows = (
        chains.withColumn("_complete", is_complete())
        .withColumns(usage)
        .select(
            "incident_id",
            "_complete",
            F.col("severity").alias("agent_severity"),
            "diagnostic",
            "postmortem",
            *usage,
            *(
                F.col(f"remediation.{c}").alias(c)
                for c in (
                    "remediation_command",
                    "command_type",
                    "requires_human_approval",
                    "runbook_steps",
                )
            ),
        )
    )
    decided = (
        decide(chain_rows, rules)
        .withColumnsRenamed({"remediation": "decided_remediation", "governance": "decided_governance"})
        .withColumnsRenamed({"incident_id": "_chain_id"})
    )
    joined = _with_times(incidents).join(decided, F.col("request_id") == F.col("_chain_id"), how)
    return joined.withColumn("_complete", F.coalesce("_complete", F.lit(False)))


def full_reports(incidents: DataFrame, chains: DataFrame, rules: Rules) -> DataFrame:
    """Reports of anchored incidents with a complete chain.

    The reported severity is the severity agent's; the one found in the dump only
    decides whether the agents are asked.
    """
    joined = joined_chains(incidents.filter(has_anchor()), chains, rules, "inner")
    return joined.filter("_complete").select(*_typed(_agent_report()))


def all_reports(incidents: DataFrame, chains: DataFrame, rules: Rules) -> DataFrame:
    """Both kinds of report in one pass over the incidents.

    A left join keeps the incidents that need no agents, so the dumps are
    searched once rather than once per kind.
    """
    joined = joined_chains(incidents, chains, rules, "left").withColumn("_found", has_anchor())
    fixed, agents = _fixed_report(), _agent_report()
    chosen = {
        f.name: F.when(F.col("_found"), agents[f.name].cast(f.dataType)).otherwise(
            fixed[f.name].cast(f.dataType)
        )
        for f in schemas.REPORT.fields
    }
    return joined.filter(~F.col("_found") | F.col("_complete")).select(*_typed(chosen))


def escalations(reports: DataFrame) -> DataFrame:
    """One message per report whose command was blocked."""
    reason = F.coalesce(F.nullif("remediation.block_reason", F.lit("")), F.lit(DEFAULT_REASON))
    return reports.filter(F.col("remediation.status") == schemas.BLOCKED).select(
        "incident_id",
        "service_name",
        reason.alias("block_reason"),
        F.format_string(ESCALATION, F.col("incident_id"), F.col("service_name"), reason).alias("message"),
    )


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON text per report, nulls written out."""
    return reports.select(
        "incident_id",
        F.to_json(F.struct(*schemas.REPORT.names), {"ignoreNullFields": "false"}).alias("report"),
    )
