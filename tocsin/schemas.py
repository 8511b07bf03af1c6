"""Fixed row types of the records the jobs read, pass on and write."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations and length limits of the record types.
ENVIRONMENTS = ["dev", "staging", "prod"]
SEVERITIES = ["FATAL", "ERROR"]
COMMAND_TYPES = ["shell", "kubectl", "sql", "http", "none"]
APPROVED = "APPROVED"
BLOCKED = "BLOCKED_ESCALATED"
SERVICE_NAME_MAX = 128
PAYLOAD_MAX = 2_000_000
WINDOW_MIN = 1
WINDOW_MAX = 50
WINDOW_DEFAULT = 10

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("log_payload", T.StringType()),
        T.StructField("max_context_lines", T.LongType()),
    ]
)

# What is kept of a line that is no request.
REJECTED = [
    "request_key",
    "request_id",
    "service_name",
    "environment",
    "max_context_lines",
    "path",
    "offset",
    "n_bytes",
    "payload_bytes",
    "payload_sha256",
    "errors",
]

LOG_LINE = T.StructType(
    [
        T.StructField("incident_id", T.LongType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("raw", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("command_type", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("pattern", T.StringType()),
    ]
)

TEMPLATE = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)

ATTEMPT = T.StructType(
    [
        T.StructField("incident_id", T.LongType()),
        T.StructField("agent", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("primary_text", T.StringType()),
        T.StructField("primary_prompt_tokens", T.LongType()),
        T.StructField("primary_completion_tokens", T.LongType()),
        T.StructField("fallback_text", T.StringType()),
        T.StructField("fallback_prompt_tokens", T.LongType()),
        T.StructField("fallback_completion_tokens", T.LongType()),
        T.StructField("ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

_TEXTS = T.ArrayType(T.StringType())

REMEDIATION = T.StructType(
    [
        T.StructField("command", T.StringType()),
        T.StructField("command_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("block_reason", T.StringType()),
        T.StructField("runbook_steps", _TEXTS),
    ]
)

POST_MORTEM = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("contributing_factors", _TEXTS),
        T.StructField("preventive_actions", _TEXTS),
        T.StructField("impact_assessment", T.StringType()),
    ]
)

GOVERNANCE = T.StructType(
    [
        T.StructField("guardrail_triggered", T.BooleanType()),
        T.StructField("matched_denylist_pattern", T.StringType()),
        T.StructField("allowlist_verb", T.StringType()),
    ]
)

TIMING = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("preprocessing", "inference", "governance", "total")]
)

TOKENS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("prompt_tokens", "completion_tokens")]
)

REPORT = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("severity_detected", T.StringType()),
        T.StructField("root_cause", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("remediation", REMEDIATION),
        T.StructField("post_mortem", POST_MORTEM),
        T.StructField("governance", GOVERNANCE),
        T.StructField("timing_ms", TIMING),
        T.StructField("token_usage", TOKENS),
    ]
)
