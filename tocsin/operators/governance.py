"""Proposed commands against an ordered rule table.

Deny patterns come first, then the allowed prefixes of the command's type, then
the approval flag.  The rules are few, so they become one expression that Spark
compiles into the scan stage: no join, no shuffle, no pair of every command with
every rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.functions.rows import computed_once
from tocsin.functions.text import sql_text, strip
from tocsin.operators.screening import first_screened, with_first_prefix

DENY, ALLOW = "deny", "allow"

# Deny patterns, in order.
DENY_PATTERNS = [
    r"\brm\s+-rf\b",
    r"\bmkfs\.",
    r"\bdd\s+if=",
    r"\bshutdown\b",
    r"\breboot\b",
    r"\binit\s+0\b",
    r":\(\)\s*\{\s*:\|\:&\s*\}\s*;\s*:",
    r"\bDROP\s+(TABLE|DATABASE|SCHEMA)\b",
    r"\bTRUNCATE\b",
    r"\bDELETE\s+FROM\s+\w+(?!\s+WHERE)",
    r"\bkubectl\s+delete\s+(ns|namespace|pv|persistentvolume)\b",
    r"\bchmod\s+-R\s+777\s+/",
    r"\bchown\s+-R\b.*\s+/\s*$",
    r"\bdocker\s+system\s+prune\s+-a\s+-f\b",
    r"\bterraform\s+destroy\b",
    r"\biptables\s+-F\b",
    r"\bufw\s+disable\b",
]

# Allowed prefixes by command type, in order.
ALLOWED_PREFIXES = {
    "kubectl": [
        "kubectl rollout restart",
        "kubectl scale",
        "kubectl describe",
        "kubectl logs",
        "kubectl get",
        "kubectl top",
        "kubectl rollout status",
        "kubectl rollout undo",
    ],
    "shell": [
        "systemctl restart",
        "systemctl status",
        "systemctl reload",
        "journalctl",
        "df -h",
        "free -m",
        "netstat",
        "ps aux",
        "kill -HUP",
        "curl -I",
        "tail -n",
    ],
    "sql": ["SELECT", "EXPLAIN", "SHOW", "ANALYZE"],
    "http": ["GET ", "POST /health", "POST /restart-worker"],
    "none": [""],
}

# Texts of the block reasons.
DENIED = "Denylist match: destructive pattern '{}' detected. Escalated to on-call."
NOT_ALLOWED = (
    "Command did not match an approved allowlist verb, or the agent flagged "
    "requires_human_approval. Escalated to on-call."
)


# Rules of one expression; longer tables are screened first.
CHUNK = 200


@dataclass(frozen=True)
class Rules:
    """A rule set in order: deny patterns, and allowed prefixes by command type."""

    deny: list[str] = field(default_factory=lambda: list(DENY_PATTERNS))
    allow: dict[str, list[str]] = field(
        default_factory=lambda: {t: list(p) for t, p in ALLOWED_PREFIXES.items()}
    )

    def rows(self) -> list[tuple[str, str | None, int, str]]:
        denied = [(DENY, None, n, p) for n, p in enumerate(self.deny, 1)]
        allowed = [
            (ALLOW, kind, n, p) for kind, ps in self.allow.items() for n, p in enumerate(ps, 1)
        ]
        return denied + allowed

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), schemas.RULE)


def engine_pattern(pattern: str) -> str:
    """A deny pattern with the meaning it has for Python, ignoring case.

    Letters fold by Unicode, only LF ends a line, and white space includes the
    four separators 0x1C to 0x1F.  Groups may have names and be referred to by them.
    """
    meant = {r"\s": r"[\s\x1c-\x1f]", "(?P<": "(?<"}

    def translated(found: re.Match) -> str:
        return rf"\k<{found[1]}>" if found[1] else meant.get(found[0], found[0])

    return "(?iUd)" + re.sub(r"\\.|\(\?P=(\w+)\)|\(\?P<", translated, pattern, flags=re.S)


def normalised(command: Column) -> Column:
    return strip(F.coalesce(command, F.lit("")))


def is_noop(command: Column, command_type: Column) -> Column:
    return F.coalesce(command_type == "none", F.lit(False)) | (command == "")


def first_denied(rules: Rules) -> Column:
    """Position (from 1) of the first deny pattern found in ``cmd``, or null."""
    tests = [
        f"WHEN cmd RLIKE {sql_text(engine_pattern(p))} THEN {n}"
        for n, p in enumerate(rules.deny, 1)
    ]
    return F.expr(f"CASE {' '.join(tests)} END" if tests else "CAST(NULL AS INT)")


def denied_pattern(rules: Rules) -> Column:
    """The text of that pattern."""
    texts = F.expr(f"array({', '.join(map(sql_text, rules.deny))})").cast("array<string>")
    return F.try_element_at(texts, first_denied(rules))


def allowed_verb(rules: Rules) -> Column:
    """The first prefix of ``command_type`` that ``cmd`` starts with, or null."""
    tests = [
        f"WHEN command_type = {sql_text(kind)} AND startswith(cmd, {sql_text(p)}) THEN {sql_text(p)}"
        for kind, prefixes in rules.allow.items()
        for p in prefixes
    ]
    return F.expr(f"CASE {' '.join(tests)} END" if tests else "CAST(NULL AS STRING)")


def judge(commands: DataFrame, rules: Rules) -> DataFrame:
    """Add the normalised command and what each rule says about it.

    Columns ``cmd``, ``noop``, ``deny_pattern`` and ``verb``; later rules are
    looked at only where earlier ones have not decided.  Tables of more than
    ``CHUNK`` rules of a kind are screened (``tocsin.operators.screening``).
    """
    if max(len(rules.deny), sum(map(len, rules.allow.values()))) > CHUNK:
        return judge_screened(commands, rules)
    cmd, kind, noop = F.col("cmd"), F.col("command_type"), F.col("noop")
    clean = commands.withColumn("cmd", normalised(F.col("remediation_command")))
    denied = computed_once(
        clean.withColumn("noop", is_noop(cmd, kind)),
        {"cmd": cmd, "noop": noop, "deny_pattern": F.when(~noop, denied_pattern(rules))},
    )
    still = ~noop & F.col("deny_pattern").isNull()
    return computed_once(denied, {"verb": F.when(still, allowed_verb(rules))})


def judge_screened(commands: DataFrame, rules: Rules) -> DataFrame:
    """``judge`` for rule tables of any size."""
    clean = commands.withColumn("cmd", normalised(F.col("remediation_command")))
    clean = computed_once(clean, {"cmd": F.col("cmd"), "noop": is_noop(F.col("cmd"), F.col("command_type"))})
    asked = clean.withColumn("_asked", F.when(~F.col("noop"), F.col("cmd")))
    place = asked.withColumn("_place", first_screened(asked, rules.deny, "_asked"))
    denied = with_pattern(place, rules).drop("_place")
    still = denied.withColumn("_asked", F.when(F.col("deny_pattern").isNull(), F.col("_asked")))
    prefixes = rules.table(commands.sparkSession).filter(F.col("kind") == ALLOW).drop("kind")
    return with_first_prefix(still, prefixes, "verb", "_asked").drop("_asked")


def with_pattern(placed: DataFrame, rules: Rules) -> DataFrame:
    """The text of the deny pattern at ``_place``, by a join with the rule rows."""
    table = rules.table(placed.sparkSession).filter(F.col("kind") == DENY)
    return placed.join(table.select(F.col("ordinal").alias("_place"), F.col("pattern").alias("deny_pattern")), "_place", "left")


def decide(commands: DataFrame, rules: Rules, verdicts: bool = False) -> DataFrame:
    """Add the nested ``remediation`` and ``governance`` blocks.

    A blocked command is withheld.  Runbook steps survive a no-op, a denial and
    an approval, but not a missing prefix or a pending approval.  ``verdicts``
    keeps the columns of ``judge``.
    """
    if "runbook_steps" not in commands.columns:
        commands = commands.withColumn("runbook_steps", F.lit(None).cast("array<string>"))
    judged = judge(commands, rules)
    none = F.array().cast("array<string>")
    steps = F.coalesce("runbook_steps", none)
    noop, denied = F.col("noop"), F.col("deny_pattern").isNotNull()
    held = F.col("verb").isNull() | F.coalesce("requires_human_approval", F.lit(False))
    blocked = ~noop & (denied | held)
    prefix, suffix = DENIED.split("{}")
    reason = (
        F.when(denied, F.concat(F.lit(prefix), F.col("deny_pattern"), F.lit(suffix)))
        .when(blocked, F.lit(NOT_ALLOWED))
    )
    remediation = F.struct(
        F.when(~noop & ~blocked, F.col("cmd")).alias("command"),
        F.when(noop, F.lit("none")).otherwise(F.col("command_type")).alias("command_type"),
        F.when(blocked, F.lit(schemas.BLOCKED)).otherwise(F.lit(schemas.APPROVED)).alias("status"),
        reason.alias("block_reason"),
        F.when(blocked & ~denied, none).otherwise(steps).alias("runbook_steps"),
    )
    governance = F.struct(
        blocked.alias("guardrail_triggered"),
        F.col("deny_pattern").alias("matched_denylist_pattern"),
        F.when(~noop & ~blocked, F.col("verb")).alias("allowlist_verb"),
    )
    decided = judged.withColumn("remediation", remediation).withColumn("governance", governance)
    return decided if verdicts else decided.drop("cmd", "noop", "deny_pattern", "verb")


def denied_by_table(commands: DataFrame, rules: Rules, spark: SparkSession) -> DataFrame:
    """Denied commands joined to their rule row, by kind and position.

    The position is found without a join; the equi-join then brings in whatever
    other columns a rule table carries.
    """
    clean = commands.withColumn("cmd", normalised(F.col("remediation_command")))
    if len(rules.deny) > CHUNK:
        positioned = clean.withColumn("ordinal", first_screened(clean, rules.deny))
    else:
        positioned = computed_once(clean, {"ordinal": first_denied(rules)})
    positioned = positioned.filter(F.col("ordinal").isNotNull() & ~is_noop(F.col("cmd"), F.col("command_type")))
    deny_rows = rules.table(spark).filter(F.col("kind") == DENY).select("ordinal", "pattern")
    return positioned.join(deny_rows, "ordinal")


def rule_usage(commands: DataFrame, rules: Rules, spark: SparkSession) -> DataFrame:
    """Every rule of the table with the number of commands it decided."""
    judged = judge(commands, rules)
    used = (
        judged.select(
            F.when(F.col("deny_pattern").isNotNull(), DENY)
            .when(F.col("verb").isNotNull(), ALLOW)
            .alias("kind"),
            F.when(F.col("deny_pattern").isNull(), F.col("command_type")).alias("command_type"),
            F.coalesce("deny_pattern", "verb").alias("pattern"),
        )
        .filter(F.col("kind").isNotNull())
        .groupBy("kind", "command_type", "pattern")
        .agg(F.count("*").alias("commands"))
    )
    table = rules.table(spark)
    same = (
        (table["kind"] == used["kind"])
        & table["command_type"].eqNullSafe(used["command_type"])
        & (table["pattern"] == used["pattern"])
    )
    return table.join(used, same, "left").select(
        table["kind"],
        table["command_type"],
        table["ordinal"],
        table["pattern"],
        F.coalesce("commands", F.lit(0)).alias("commands"),
    )


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy(
        F.col("remediation.status").alias("status"),
        F.col("remediation.command_type").alias("command_type"),
        F.col("governance.matched_denylist_pattern").alias("pattern"),
    ).agg(F.count("*").alias("commands"))
