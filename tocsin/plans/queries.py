"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin import schemas
from tocsin.functions.text import split_lines
from tocsin.operators import agents, answers, governance, logs, metrics, prompts, reports, validation
from tocsin.plans import inputs, triage
from tocsin.session import shared_folder, written
from tocsin.sources import requests as request_sources
from tocsin.sources import rules as rule_sources
from tocsin.sources import sinks
from tocsin.streaming.answers import start_late_triage, stream_attempts
from tocsin.streaming.triage import QUARANTINE, REPORTS, UNAVAILABLE, committed, start_triage

Query = Callable[[SparkSession, str], DataFrame]
RULES = governance.Rules()
_REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTERED[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def _joined(column: str, name: str | None = None) -> Column:
    """A list of texts as one text, so that results compare by value."""
    return F.array_join(column, "|").alias(name or column.split(".")[-1])


# --- log lines ---------------------------------------------------------------


@query
def log_lines(spark, folder):
    return logs.dump_lines(inputs.requests(spark, folder)).select("request_id", "line_no", "raw")


@query
def severity_tags(spark, folder):
    return logs.tag_severity(logs.dump_lines(inputs.requests(spark, folder))).select(
        "request_id", "line_no", "severity"
    )


@query
def severity_filter(spark, folder):
    return logs.only_tier(logs.tag_severity(inputs.log_lines(spark, folder)), logs.FATAL)


def _anchors(spark, folder) -> DataFrame:
    return logs.crash_anchors(logs.tag_severity(inputs.log_lines(spark, folder)))


@query
def crash_anchor(spark, folder):
    return _anchors(spark, folder).select("incident_id", "anchor")


@query
def anchor_severity(spark, folder):
    return _anchors(spark, folder).filter("anchor IS NOT NULL").select("incident_id", "anchor_severity")


def _stored_lines(spark, folder) -> DataFrame:
    """The line table as it would be stored: numbered once."""
    return written(inputs.log_lines(spark, folder), "lines")


def _window_lines(spark, folder) -> DataFrame:
    lines = _stored_lines(spark, folder)
    anchors = logs.crash_anchors(logs.tag_severity(lines))
    return logs.context_window(lines, anchors, F.expr(inputs.LINE_WINDOW))


@query
def context_window(spark, folder):
    return _window_lines(spark, folder).select("incident_id", "line_no", "raw", "anchor")


@query
def context_text(spark, folder):
    return logs.context_text(_window_lines(spark, folder))


@query
def token_estimate(spark, folder):
    return preprocess_lines(spark, folder).select("incident_id", "est_tokens")


@query
def preprocess_lines(spark, folder):
    return logs.preprocess_lines(_stored_lines(spark, folder), F.expr(inputs.LINE_WINDOW))


@query
def preprocess_array(spark, folder):
    return triage.incidents_of(inputs.requests(spark, folder)).select(
        "request_id", "n_lines", "anchor", "severity", "context", "n_context", "est_tokens"
    )


@query
def context_bound(spark, folder):
    return logs.context_bound(
        triage.incidents_of(inputs.requests(spark, folder)), F.col("max_context_lines")
    )


@query
def noise_reduction(spark, folder):
    return logs.noise_reduction(preprocess_lines(spark, folder))


# --- requests ----------------------------------------------------------------


def _checked_requests(spark, folder) -> DataFrame:
    return validation.check_requests(
        validation.with_default_window(inputs.requests(spark, folder))
    )


@query
def validate_requests(spark, folder):
    return validation.accepted(validation.with_default_window(inputs.requests(spark, folder)))


@query
def quarantine_requests(spark, folder):
    return validation.quarantined(_checked_requests(spark, folder)).select(
        "request_id", "service_name", "environment", "max_context_lines", "error"
    )


# Bytes of the table of dumps for each file that a stream finds, and the least number of files.
FILE_BYTES, LEAST_FILES = 16 << 20, 4


def _stream_files(spark, folder) -> int:
    """How many files a stream of requests has: their number grows with the table, not their size."""
    files = inputs.table(spark, folder, "documents").select("_metadata.file_path", "_metadata.file_size").distinct()
    n_bytes = files.agg(F.sum("file_size").alias("n_bytes")).first().n_bytes or 0
    return max(LEAST_FILES, -(-n_bytes // FILE_BYTES))


def _request_files(spark, folder, n_files: int | None = None) -> str:
    """The requests as JSON lines, where all executors can read them."""
    path = shared_folder(spark, "requests")
    rows = inputs.requests(spark, folder)
    (rows.repartition(n_files) if n_files else rows).write.json(path)
    return path


@query
def ingest_requests(spark, folder):
    return request_sources.read_requests(spark, _request_files(spark, folder)).select(
        F.col("request_id").try_cast("bigint").alias("request_id"),
        "service_name",
        "environment",
        "log_payload",
        "max_context_lines",
        _joined("errors"),
    )


def _log_files(spark, folder) -> str:
    """Dumps as ``*.log`` files, those of neighbouring requests in one, named by their service."""
    path = shared_folder(spark, "dumps")
    number = F.expr(f"request_id div {inputs.DUMPS_PER_FILE}")
    dumps = F.sort_array(F.collect_list(F.struct("request_id", "log_payload")))
    files = inputs.requests(spark, folder).groupBy(number.alias("n")).agg(
        F.array_join(F.transform(dumps, lambda d: d["log_payload"]), "\n").alias("text")
    )
    named = files.where("text <> ''").select(F.format_string("svc-%d", "n").alias("name"), "text")
    sinks.write_text_files(named, path, ".log")
    return path


@query
def scan_log_files(spark, folder):
    """One row per file: the service its name gives, and what it holds."""
    found = request_sources.log_files(spark, _log_files(spark, folder))
    return found.select(
        "service_name",
        "environment",
        "max_context_lines",
        _joined("errors"),
        F.size(split_lines(F.col("log_payload"))).cast("bigint").alias("lines"),
        F.length("log_payload").cast("bigint").alias("characters"),
        F.sha2("log_payload", 256).alias("payload_sha256"),
    )


@query
def scan_log_lines(spark, folder):
    """Numbered lines of the same files, read by ranges; one row per file and severity."""
    lines = request_sources.scan_log_lines(spark, _log_files(spark, folder))
    return (
        logs.tag_severity(lines)
        .groupBy("service_name", "severity")
        .agg(
            F.count("*").alias("lines"),
            F.min("line_no").alias("first"),
            F.max("line_no").alias("last"),
            F.sum(F.col("line_no") * F.length("raw")).alias("weighted"),
        )
    )


# --- rules and commands ------------------------------------------------------


@query
def rules_table(spark, folder):
    """The rule table as stored and read back, with how often each rule decided."""
    path = shared_folder(spark, "rules")
    rule_sources.write_rules(spark, RULES, path)
    read = rule_sources.read_rules(spark, path)
    return governance.rule_usage(inputs.commands(spark, folder), read, spark)


def _judged(spark, folder) -> DataFrame:
    return governance.judge(inputs.commands(spark, folder), RULES)


def _decided(spark, folder) -> DataFrame:
    return governance.decide(inputs.commands(spark, folder), RULES)


@query
def gov_normalize(spark, folder):
    return inputs.commands(spark, folder).select(
        "command_id", governance.normalised(F.col("remediation_command")).alias("command")
    )


@query
def gov_noop(spark, folder):
    return (
        _decided(spark, folder)
        .filter("remediation.command_type = 'none'")
        .select(
            "command_id",
            "remediation.status",
            "remediation.command",
            _joined("remediation.runbook_steps"),
            "governance.guardrail_triggered",
        )
    )


@query
def gov_deny(spark, folder):
    return _judged(spark, folder).filter("deny_pattern IS NOT NULL").select("command_id", "deny_pattern")


@query
def gov_deny_join(spark, folder):
    return governance.denied_by_table(inputs.commands(spark, folder), RULES, spark).select(
        "command_id", "ordinal", "pattern"
    )


@query
def gov_allow(spark, folder):
    return _judged(spark, folder).filter("verb IS NOT NULL").select("command_id", "command_type", "verb")


def _large_rules() -> governance.Rules:
    return governance.Rules(*inputs.large_rules(RULES.deny, RULES.allow))


@query
def gov_deny_large(spark, folder):
    """The first of 5,000 deny patterns."""
    judged = governance.judge(inputs.commands(spark, folder), _large_rules())
    return judged.filter("deny_pattern IS NOT NULL").select("command_id", "deny_pattern")


@query
def gov_allow_large(spark, folder):
    """The first of 50,000 prefixes."""
    judged = governance.judge(inputs.commands(spark, folder), _large_rules())
    return judged.filter("verb IS NOT NULL").select("command_id", "command_type", "verb")


@query
def gov_approval(spark, folder):
    """Commands that wait for a human, with what would have allowed them."""
    return (
        governance.decide(inputs.commands(spark, folder), RULES, verdicts=True)
        .filter("requires_human_approval AND NOT noop AND deny_pattern IS NULL")
        .select(
            "command_id",
            F.col("verb").alias("matching_prefix"),
            "remediation.status",
            "governance.allowlist_verb",
        )
    )


def _flat_decision() -> list[Column]:
    return [
        F.col("remediation.command").alias("command"),
        F.col("remediation.command_type").alias("decided_type"),
        F.col("remediation.status").alias("status"),
        F.col("remediation.block_reason").alias("block_reason"),
        _joined("remediation.runbook_steps", "steps"),
        F.col("governance.guardrail_triggered").alias("guardrail_triggered"),
        F.col("governance.matched_denylist_pattern").alias("matched_denylist_pattern"),
        F.col("governance.allowlist_verb").alias("allowlist_verb"),
    ]


@query
def gov_decision(spark, folder):
    return _decided(spark, folder).select("command_id", *_flat_decision())


@query
def gov_reason(spark, folder):
    return (
        _decided(spark, folder)
        .filter("remediation.block_reason IS NOT NULL")
        .select("command_id", "remediation.block_reason")
    )


@query
def gov_unified(spark, folder):
    """Proposals of both kinds in one table; unified answers carry no steps."""
    proposed = inputs.commands(spark, folder).select(
        F.lit("remediation").alias("kind"),
        F.col("command_id").alias("proposal_id"),
        "remediation_command",
        "command_type",
        "requires_human_approval",
        "runbook_steps",
    )
    unified = (
        _read(spark, folder, ["unified"])
        .filter(F.size("errors") == 0)
        .select(
            F.lit("unified").alias("kind"),
            (F.col("incident_id") * 10 + F.col("attempt")).alias("proposal_id"),
            "remediation_command",
            "command_type",
            "requires_human_approval",
        )
    )
    both = proposed.unionByName(unified, allowMissingColumns=True)
    return governance.decide(both, RULES).select("kind", "proposal_id", *_flat_decision())


@query
def gov_summary(spark, folder):
    return governance.decision_counts(_decided(spark, folder))


# --- answers -----------------------------------------------------------------


def _read(spark, folder, names: list[str] | None = None) -> DataFrame:
    return answers.read_answers(inputs.answers(spark, folder), names)


def _validated(spark, folder, agent: str) -> DataFrame:
    fields = [
        _joined(f.name) if f.kind == validation.TEXTS else F.col(f.name)
        for f in validation.ANSWERS[agent]
    ]
    return _read(spark, folder, [agent]).select("incident_id", "attempt", _joined("errors"), *fields)


@query
def validate_severity(spark, folder):
    return _validated(spark, folder, "severity")


@query
def validate_diagnostic(spark, folder):
    return _validated(spark, folder, "diagnostic")


@query
def validate_remediation(spark, folder):
    return _validated(spark, folder, "remediation")


@query
def validate_postmortem(spark, folder):
    return _validated(spark, folder, "postmortem")


@query
def validate_unified(spark, folder):
    return _validated(spark, folder, "unified")


@query
def transport_fallback(spark, folder):
    return answers.choose_transport(inputs.answers(spark, folder)).select(
        "incident_id",
        "agent",
        "attempt",
        "raw_answer",
        "transport",
        "reported_prompt_tokens",
        "reported_completion_tokens",
    )


@query
def fence_strip(spark, folder):
    chosen = answers.choose_transport(inputs.answers(spark, folder))
    return answers.strip_fences(chosen).select("incident_id", "agent", "attempt", "answer_text")


@query
def parse_answers(spark, folder):
    return _read(spark, folder).select(
        "incident_id",
        "agent",
        "attempt",
        (F.size("errors") == 0).alias("valid"),
        _joined("errors"),
        "severity_detected",
        "root_cause",
        "confidence_score",
        "remediation_command",
        "summary",
    )


@query
def first_valid_attempt(spark, folder):
    return answers.first_valid_attempts(_read(spark, folder)).withColumn(
        "last_error", _joined("last_error")
    )


@query
def token_fallback(spark, folder):
    chosen = answers.choose_transport(inputs.answers(spark, folder))
    return answers.fill_tokens(answers.strip_fences(chosen)).select(
        "incident_id", "agent", "attempt", "prompt_tokens", "completion_tokens"
    )


def _chains(spark, folder) -> DataFrame:
    return triage.chains_of(inputs.answers(spark, folder))


@query
def agent_chain(spark, folder):
    return _chains(spark, folder).select(
        "incident_id",
        answers.is_complete().alias("complete"),
        F.col("severity.severity_detected").alias("severity_detected"),
        F.col("diagnostic.root_cause").alias("root_cause"),
        F.col("diagnostic.confidence_score").alias("confidence_score"),
        F.col("remediation.remediation_command").alias("remediation_command"),
        F.col("remediation.requires_human_approval").alias("requires_human_approval"),
        _joined("remediation.runbook_steps"),
        F.col("postmortem.summary").alias("summary"),
    )


@query
def usage_totals(spark, folder):
    return answers.usage_totals(triage.usage_of(inputs.answers(spark, folder)))


@query
def unavailable(spark, folder):
    return triage.dead_letters_of(inputs.requests(spark, folder), inputs.answers(spark, folder)).drop(
        "incident_key"
    )


# --- prompts -----------------------------------------------------------------


def _anchored(spark, folder) -> DataFrame:
    incidents = triage.incidents_of(inputs.requests(spark, folder))
    return incidents.filter(reports.has_anchor())


def _with_chain(spark, folder, *needed: str) -> DataFrame:
    """Anchored incidents whose needed agents have answered; only their answers are read."""
    chains = triage.chains_of(inputs.answers(spark, folder), list(needed))
    return triage.with_upstream(_anchored(spark, folder), chains, list(needed))


@query
def prompt_severity(spark, folder):
    return _anchored(spark, folder).select("request_id", prompts.severity_prompt().alias("prompt"))


@query
def prompt_diagnostic(spark, folder):
    return _with_chain(spark, folder, "severity").select(
        "request_id", prompts.diagnostic_prompt(F.col("agent_severity")).alias("prompt")
    )


@query
def prompt_remediation(spark, folder):
    return _with_chain(spark, folder, "severity", "diagnostic").select(
        "request_id",
        prompts.remediation_prompt(F.col("root_cause"), F.col("explanation")).alias("prompt"),
    )


@query
def prompt_postmortem(spark, folder):
    upstream = [F.col(c) for c in ("agent_severity", "root_cause", "explanation", "command")]
    return _with_chain(spark, folder, "severity", "diagnostic", "remediation").select(
        "request_id", prompts.postmortem_prompt(*upstream).alias("prompt")
    )


@query
def prompt_unified(spark, folder):
    return _anchored(spark, folder).select("request_id", prompts.unified_prompt().alias("prompt"))


@query
def prompt_from_table(spark, folder):
    """Severity prompts from a table of two versions; requests take one or the other."""
    table = prompts.template_rows(spark).unionByName(
        prompts.template_rows(spark, {"severity": inputs.OTHER_SEVERITY}, 2)
    )
    version = (F.col("request_id") % 2 + 1).cast("int")
    asked = prompts.prompts_from_table(_anchored(spark, folder), table, "severity", prompts.asked_values(), version)
    return asked.select("request_id", version.alias("version"), "prompt")


@query
def metadata_json(spark, folder):
    """Over the texts themselves as service names, so that escapes are met."""
    return inputs.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        prompts.metadata_json(F.col("text"), F.col("role")).alias("metadata"),
    )


def sample_models() -> tuple[agents.Model, agents.Model]:
    """Stand-ins for a model and its fallback: answers tell the prompt's length."""

    def model(asked):
        return [
            ConnectionError("no route")
            if len(prompt) % 3 == 0
            else (f'{{"severity_detected": "ERROR", "severity_reasoning": "{len(prompt)}"}}', 0, 0)
            for prompt in asked
        ]

    def fallback(asked):
        return [
            ConnectionError("no route") if len(prompt) % 9 == 0 else (f"length {len(prompt)}", 1, 2)
            for prompt in asked
        ]

    return model, fallback


@query
def agent_map(spark, folder):
    asked = _anchored(spark, folder).select(
        F.col("request_id").alias("incident_id"),
        F.lit("severity").alias("agent"),
        prompts.severity_prompt().alias("prompt"),
    )
    path = shared_folder(spark, "attempts")
    agents.ask_model(asked, *sample_models()).write.parquet(path)
    return answers.choose_transport(spark.read.parquet(path)).select(
        "incident_id", "attempt", "raw_answer", "transport", "reported_prompt_tokens", "error"
    )


def chain_model() -> agents.Model:
    """A stand-in for a model of all four agents.

    Prompts of a length that 7 divides find no route, others that 5 divides get
    an answer against the rules, and the rest a good one that tells the length.
    """
    starts = {prompts.TEMPLATES[agent][:20]: agent for agent in answers.CHAIN}

    def reply(prompt):
        n, agent = len(prompt), starts[prompt[:20]]
        if n % 7 == 0:
            return ConnectionError("no route")
        if n % 5 == 0:
            return '{"confidence_score": "high", "severity_detected": 5, "summary": []}', 0, 0
        body = {
            "severity": f'"severity_detected": "{("ERROR", "FATAL")[n % 2]}"',
            "diagnostic": f'"root_cause": "cause {n}", "confidence_score": 0.5, "explanation": "seen {n}"',
            "remediation": f'"remediation_command": "df -h /{n}", "command_type": "shell", '
            '"requires_human_approval": false',
            "postmortem": f'"summary": "review {n}"',
        }[agent]
        return f"{{{body}}}", n, 1

    return lambda asked: [reply(prompt) for prompt in asked]


@query
def agent_run(spark, folder):
    """All attempts of the four agents over the accepted, anchored incidents."""
    incidents = triage.incidents_of(inputs.requests(spark, folder))
    ran = triage.run_agents(incidents, chain_model(), shared_folder(spark, "run"))
    return answers.read_answers(ran, answers.CHAIN).select(
        "incident_id",
        "agent",
        "attempt",
        F.length("prompt").cast("bigint").alias("prompt_length"),
        "raw_answer",
        (F.size("errors") == 0).alias("valid"),
        "error",
    )


# --- reports -----------------------------------------------------------------


def _flat_report() -> list[Column]:
    return [
        *(
            F.col(c)
            for c in (
                "incident_id",
                "service_name",
                "severity_detected",
                "root_cause",
                "confidence_score",
                "explanation",
            )
        ),
        *_flat_decision(),
        F.col("post_mortem.summary").alias("summary"),
        _joined("post_mortem.contributing_factors"),
        _joined("post_mortem.preventive_actions"),
        F.col("post_mortem.impact_assessment").alias("impact_assessment"),
        F.col("timing_ms.inference").alias("inference"),
        F.col("timing_ms.total").alias("total"),
        F.col("token_usage.prompt_tokens").alias("prompt_tokens"),
        F.col("token_usage.completion_tokens").alias("completion_tokens"),
    ]


def _all_reports(spark, folder) -> DataFrame:
    return triage.reports_of(inputs.requests(spark, folder), inputs.answers(spark, folder), RULES)


@query
def report_no_anchor(spark, folder):
    incidents = triage.incidents_of(inputs.requests(spark, folder))
    return reports.no_anchor_reports(incidents).select(*_flat_report())


@query
def report_full(spark, folder):
    incidents = triage.incidents_of(inputs.requests(spark, folder))
    return reports.full_reports(incidents, _chains(spark, folder), RULES).select(*_flat_report())


@query
def report_all(spark, folder):
    return _all_reports(spark, folder).select(*_flat_report())


@query
def report_json(spark, folder):
    return reports.report_json(_all_reports(spark, folder))


@query
def escalations(spark, folder):
    return reports.escalations(_all_reports(spark, folder))


@query
def timing_block(spark, folder):
    value = F.col("value")
    block = reports.timing_block(value / 7, value / 3, value / 11, value)
    return inputs.table(spark, folder, "events").select("event_id", block.alias("t")).select(
        "event_id", "t.*"
    )


@query
def incident_key(spark, folder):
    return inputs.requests(spark, folder).select("request_id", reports.request_key().alias("incident_key"))


@query
def stream_triage(spark, folder):
    """The whole job over a stream of request files, in several micro-batches."""
    output = shared_folder(spark, "stream")
    chain_path = f"{output}/chains"
    _chains(spark, folder).write.parquet(chain_path)
    n_files = _stream_files(spark, folder)
    arriving = request_sources.stream_requests(spark, _request_files(spark, folder, n_files), -(-n_files // 2))
    running = start_triage(
        arriving, spark.read.parquet(chain_path), RULES, output, f"{output}/checkpoint"
    )
    running.awaitTermination()
    return committed(spark, output, REPORTS).select(*_flat_report())


def _flawed_lines(spark, folder) -> DataFrame:
    """A line per request; some are no JSON, others say a null window or a number for a name."""
    rows, n = inputs.requests(spark, folder), F.col("request_id") % 10
    named = F.to_json(F.struct(*schemas.REQUEST.names))
    fields = [F.lit(5).alias(c) if c == "service_name" else F.col(c) for c in schemas.REQUEST.names]
    rest = [F.col(c) for c in schemas.REQUEST.names if c != "max_context_lines"]
    windowless = F.to_json(F.struct(*rest))
    line = (
        F.when(n == 3, F.concat(F.lit("broken "), F.col("request_id").cast("string")))
        .when(n == 4, F.concat(F.left(windowless, F.length(windowless) - 1), F.lit(', "max_context_lines": null}')))
        .when(n == 5, F.to_json(F.struct(*fields)))
        .otherwise(named)
    )
    return rows.select(line.alias("value"))


@query
def stream_quarantine(spark, folder):
    """Lines of a stream by their reasons, with their keys; accepted ones are those with a report or a dead letter."""
    output, source = shared_folder(spark, "stream"), shared_folder(spark, "lines")
    lines = _flawed_lines(spark, folder)
    n_files = _stream_files(spark, folder)
    lines.unionAll(lines).repartition(n_files).write.text(source)
    none = spark.createDataFrame([], _chains(spark, folder).schema)
    running = start_triage(
        request_sources.stream_requests(spark, source, -(-n_files // 2)), none, RULES, output, f"{output}/checkpoint"
    )
    running.awaitTermination()
    rejected = committed(spark, output, QUARANTINE).select(_joined("errors"), F.col("request_key").alias("key"))
    reported = committed(spark, output, REPORTS).select(F.lit("").alias("errors"), F.col("incident_id").alias("key"))
    waiting = committed(spark, output, UNAVAILABLE).select(F.lit("").alias("errors"), F.col("incident_key").alias("key"))
    every = rejected.unionByName(reported).unionByName(waiting)
    return every.groupBy("errors").agg(F.count("*").alias("lines"), F.countDistinct("key").alias("keys"))


# Minutes between the rounds in which attempts arrive, and that a request waits for its answers.
ROUND, WAIT = 10, 40
# More files than a round has, so that it is one batch.
ROUND_FILES = 100_000


@query
def stream_late_answers(spark, folder):
    """What becomes of every request when answers come in later files, with a restart after every round."""
    output, answered = shared_folder(spark, "stream"), shared_folder(spark, "answers")
    n_files = _stream_files(spark, folder)
    asked = _request_files(spark, folder, n_files)
    # However few row groups the table has, all tasks share the making of answers.
    attempts = inputs.answers_of(inputs.table(spark, folder, "events").hint("rebalance"))

    def minutes(n: Column) -> Column:
        return F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(60 * ROUND) * n)

    # The file's folder tells the round; a last round of a single answer only moves the clock on.
    late = F.regexp_extract("path", r"late=(\d+)", 1).cast("int")
    for number, rows in enumerate(
        [attempts.where("incident_id % 3 = 0"), attempts.where("incident_id % 3 > 0"), _tick(attempts)]
    ):
        place = number if number < 2 else number + 5
        rows.write.json(f"{answered}/late={place}")
        running = start_late_triage(
            request_sources.stream_requests(spark, asked, n_files),
            stream_attempts(spark, f"{answered}/*", ROUND_FILES),
            RULES,
            output,
            f"{output}/checkpoint",
            wait=f"{WAIT} minutes",
            clock=(minutes(F.lit(0)), minutes(late)),
        )
        running.awaitTermination()
    found = committed(spark, output, "outcomes").where("outcome <> 'orphan'")
    reported = committed(spark, output, REPORTS).select(F.col("incident_id").alias("incident_key"), "remediation.status")
    told = found.select(
        F.get_json_object("incident", "$.request_id").alias("request_id"),
        F.get_json_object("incident", "$.incident_key").alias("incident_key"),
        "outcome",
        F.when(F.col("outcome") == "dead", answers.first_missing()).alias("missing_agent"),
    )
    return told.join(reported, "incident_key", "left").drop("incident_key")


def _tick(attempts: DataFrame) -> DataFrame:
    """A valid answer to no request."""
    row = ("tick", "severity", 1, "", '{"severity_detected": "FATAL"}', 1, 1, None, None, None, 0.0, None)
    types = [T.StructField("incident_id", T.StringType()), *schemas.ATTEMPT.fields[1:]]
    return attempts.sparkSession.createDataFrame([row], T.StructType(types))


# --- metrics -----------------------------------------------------------------


def _metrics(spark, folder) -> DataFrame:
    return metrics.extract_metrics(inputs.metrics(spark, folder))


@query
def metric_extract(spark, folder):
    return _metrics(spark, folder)


@query
def metric_counts(spark, folder):
    return metrics.request_counts(_metrics(spark, folder), ["service"])


@query
def metric_percentiles(spark, folder):
    return metrics.percentiles(_metrics(spark, folder), ["service"])


@query
def metric_percentiles_global(spark, folder):
    return metrics.percentiles(_metrics(spark, folder))


@query
def metric_tokens(spark, folder):
    return metrics.token_means(_metrics(spark, folder), ["service"])


@query
def metric_verdicts(spark, folder):
    return metrics.verdicts(_metrics(spark, folder))
