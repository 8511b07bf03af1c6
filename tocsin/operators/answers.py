"""Agent answers held in tables: choose, clean, retry, chain, add up.

A table of attempts has one row per incident, agent and attempt.  Everything up
to the validated answer is a projection; picking the first valid attempt and
joining the agents of an incident is one aggregate per incident with map-side
combine, so an incident with very many attempts does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.functions.text import quarter_length, strip
from tocsin.operators.validation import ANSWERS, check_answers

# The agents in the order they depend on each other, the number of
# attempts each has, and the message of a failed incident.
CHAIN = ["severity", "diagnostic", "remediation", "postmortem"]
ATTEMPTS = 3
USAGE = ["prompt_tokens", "completion_tokens", "ms"]
UNAVAILABLE = "Triage agent triad unavailable or failed to generate valid JSON output."
NO_ANSWER = "no transport gave an answer"

FENCE_JSON, FENCE = "```json", "```"


def choose_transport(attempts: DataFrame) -> DataFrame:
    """The primary answer, or the fallback where that is null or empty.

    Fallback token counts replace the primary's only where they are reported.
    Neither answer leaves ``raw_answer`` null and ``transport`` null.
    """
    primary = F.nullif("primary_text", F.lit(""))
    fallback = F.nullif("fallback_text", F.lit(""))
    asked_fallback = primary.isNull()

    def tokens(kind: str) -> Column:
        own = F.coalesce(f"primary_{kind}_tokens", F.lit(0))
        return F.when(asked_fallback, F.coalesce(f"fallback_{kind}_tokens", own)).otherwise(own)

    return attempts.select(
        *[c for c in attempts.columns if not c.startswith(("primary_", "fallback_"))],
        F.coalesce(primary, fallback).alias("raw_answer"),
        F.when(primary.isNotNull(), "primary").when(fallback.isNotNull(), "fallback").alias("transport"),
        tokens("prompt").cast("bigint").alias("reported_prompt_tokens"),
        tokens("completion").cast("bigint").alias("reported_completion_tokens"),
    )


def strip_fences(answers: DataFrame, raw: str = "raw_answer", name: str = "answer_text") -> DataFrame:
    """Trim, drop a leading json fence, then a leading bare one, then a trailing one, trim.

    A trailing fence is looked for only in what the leading ones have left.
    """
    fences = rf"\A(?:{FENCE_JSON})?(?:{FENCE})?|{FENCE}\z"
    trimmed = strip(F.col(raw))
    bare = F.when(trimmed.contains(FENCE), strip(F.regexp_replace(trimmed, fences, "")))
    return answers.withColumn(name, F.coalesce(bare, trimmed))


def fill_tokens(answers: DataFrame) -> DataFrame:
    """Where a count is 0, estimate it from the prompt or the cleaned answer."""

    def count(kind: str, text: str) -> Column:
        reported = F.col(f"reported_{kind}_tokens")
        return F.when(reported == 0, quarter_length(F.col(text)).cast("bigint")).otherwise(reported)

    return answers.withColumn("prompt_tokens", count("prompt", "prompt")).withColumn(
        "completion_tokens", count("completion", "answer_text")
    )


def read_answers(attempts: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """Attempts to validated, typed answers; ``errors`` is empty where valid."""
    agents = agents or list(ANSWERS)
    mine = attempts.filter(F.col("agent").isin(agents))
    cleaned = fill_tokens(strip_fences(choose_transport(mine)))
    return check_answers(cleaned, agents).withColumn(
        "errors",
        F.when(F.col("raw_answer").isNull(), F.array(F.lit(NO_ANSWER))).otherwise(F.col("errors")),
    )


def first_valid_attempts(
    answers: DataFrame, key: str = "incident_id", attempts: int = ATTEMPTS
) -> DataFrame:
    """Per incident and agent the first valid answer within the allowed ``attempts``.

    Without one, ``attempt`` is null and ``last_error`` holds the reasons of the
    last allowed attempt.
    """
    valid = F.size("errors") == 0
    return (
        answers.filter(F.col("attempt") <= attempts)
        .groupBy(key, "agent")
        .agg(
            F.min(F.when(valid, F.col("attempt"))).alias("attempt"),
            F.min_by("answer_text", F.when(valid, F.col("attempt"))).alias("answer_text"),
            F.max_by("errors", "attempt").alias("last_error"),
            F.count("*").alias("tried"),
        )
        .withColumn("last_error", F.when(F.col("attempt").isNull(), F.col("last_error")))
    )


def _good(answers: DataFrame, attempts: int, agents: list[str]) -> DataFrame:
    usable = (F.col("attempt") <= attempts) & (F.size("errors") == 0)
    return answers.filter(usable & F.col("agent").isin(agents))


def agent_chains(
    answers: DataFrame,
    key: str = "incident_id",
    attempts: int = ATTEMPTS,
    agents: list[str] | None = None,
) -> DataFrame:
    """One row per incident with a struct per agent, null where the agent failed.

    ``attempts`` is the number that ``ask_model`` was given; later ones do not count.
    ``agents`` names those wanted, all four by default.

    All agents' first valid answers come out of the same aggregate, so the
    chain costs one shuffle and no joins.
    """
    agents, picked = agents or CHAIN, []
    for name in agents:
        mine = F.col("agent") == name
        fields = [f.name for f in ANSWERS[name]] + USAGE
        picked.append(
            F.min_by(F.when(mine, F.struct(*fields)), F.when(mine, F.col("attempt"))).alias(name)
        )
    return _good(answers, attempts, agents).groupBy(key).agg(*picked)


def chain_usage(answers: DataFrame, key: str = "incident_id", attempts: int = ATTEMPTS) -> DataFrame:
    """``agent_chains`` with tokens and times only: numbers fit a hash aggregate, no text is moved."""
    picked = []
    for name in CHAIN:
        attempt = F.when(F.col("agent") == name, F.col("attempt"))
        picked.append(F.min(attempt).alias(f"_{name}"))
        picked += [F.min_by(part, attempt).alias(f"_{name}_{part}") for part in USAGE]
    found = _good(answers, attempts, CHAIN).groupBy(key).agg(*picked)
    structs = [
        F.when(
            F.col(f"_{name}").isNotNull(), F.struct(*(F.col(f"_{name}_{part}").alias(part) for part in USAGE))
        ).alias(name)
        for name in CHAIN
    ]
    return found.select(key, *structs)


def is_complete() -> Column:
    """Whether all four agents of a chain row answered."""
    return F.greatest(*(F.col(a).isNull() for a in CHAIN)) == F.lit(False)


def first_missing() -> Column:
    """The first agent of the chain without a valid answer."""
    return F.coalesce(*(F.when(F.col(a).isNull(), F.lit(a)) for a in CHAIN))


def complete_chains(chains: DataFrame) -> DataFrame:
    return chains.filter(is_complete())


def usage_of_chain() -> dict[str, Column]:
    """Token and time totals of the four agents, added in chain order."""

    def total(part: str, zero) -> Column:
        sums = [F.coalesce(F.col(f"{a}.{part}"), F.lit(zero)) for a in CHAIN]
        return sums[0] + sums[1] + sums[2] + sums[3]

    return {
        "prompt_tokens": total("prompt_tokens", 0),
        "completion_tokens": total("completion_tokens", 0),
        "inference_ms": total("ms", 0.0),
    }


def usage_totals(chains: DataFrame, key: str = "incident_id") -> DataFrame:
    return complete_chains(chains).select(key, *(c.alias(n) for n, c in usage_of_chain().items()))


def unavailable(incidents: DataFrame, chains: DataFrame, key: str = "incident_id") -> DataFrame:
    """Incidents without a complete chain: one dead letter each.

    A left join rather than an anti join, because it also tells which agent of
    the chain was the first to fail.
    """
    return (
        incidents.join(chains, key, "left")
        .filter(~is_complete())
        .select(
            *incidents.columns,
            first_missing().alias("missing_agent"),
            F.lit(UNAVAILABLE).alias("detail"),
        )
    )
