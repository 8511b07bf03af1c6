"""Triage of a stream of requests whose answers arrive later, in any order, as a stream of their own.

Requests and attempts meet in a table of what waits, keyed by the request's id.
Every batch joins its rows to that of the batch before, in one aggregate, and
writes its own below the checkpoint, so a restart in between changes nothing and
no state is held in memory.  An incident whose four agents have answered becomes
a report at once; one that waits longer than allowed, by the latest clock of the
batches so far, becomes a dead letter.  Answers to no request come out when their
own wait is over.  Lines that are no requests, and dumps without an anchor, pass
through in the same batch and never reach that table, nor do payloads and
answers against the rules.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tocsin import schemas
from tocsin.operators.answers import ATTEMPTS, CHAIN, UNAVAILABLE, USAGE, first_missing, is_complete, read_answers
from tocsin.operators.governance import Rules
from tocsin.operators.reports import all_reports, escalations, has_anchor
from tocsin.operators.validation import ANSWERS
from tocsin.plans.triage import intake_of
from tocsin.streaming import triage

# What an event is, and what comes out.
REJECTED, QUIET, OPEN, ANSWER = "rejected", "quiet", "open", "answer"
COMPLETE, DEAD, ORPHAN = "complete", "dead", "orphan"
ORPHANS = "orphans"
# Columns of the answers of what waits, and the tables that a batch leaves to the next one.
ANSWERED = [c for a in CHAIN for c in (f"{a}_attempt", a)]
STATE = "incident_id string, incidents array<string>, done boolean, deadline long, " + ", ".join(
    f"{a}_attempt int, {a} string" for a in CHAIN
)
EVENTS, SETTLED, MOMENT = "events", "settled", "moment"


def waiting(before: DataFrame) -> DataFrame:
    """What the batch after it takes over from a batch's settled table."""
    complete = F.coalesce(F.col("outcome") == COMPLETE, F.lit(False))
    return before.filter(~F.col("over")).select(
        "incident_id",
        F.when(~complete, F.col("incidents")).otherwise(F.array().cast("array<string>")).alias("incidents"),
        (F.col("done") | complete).alias("done"),
        "deadline",
        *ANSWERED,
    )


def settled(before: DataFrame, events: DataFrame, wait_ms: int, moment: int | None) -> DataFrame:
    """A row per id that waits or has an event: its state, its ``outcome`` if it has one, and whether its wait is ``over``.

    ``before`` is what waited, ``moment`` the latest clock so far, in milliseconds.
    A wait counts from the request, or where there is none from the first answer.
    """
    clock = F.coalesce(F.unix_millis("clock"), F.lit(moment)) + wait_ms
    asked = F.col("kind") == OPEN
    fixed = (F.size("incidents") > 0) | F.col("done")

    def answer(agent: str, attempt: str, body: str, later: int) -> Column:
        return F.struct(F.col(attempt).alias("attempt"), F.lit(later).alias("later"), F.col(body).alias("body"))

    old = before.select(
        "incident_id",
        "incidents",
        "done",
        F.when(fixed, F.col("deadline")).alias("fixed"),
        F.lit(None).cast("long").alias("asked"),
        F.when(~fixed, F.col("deadline")).alias("answered"),
        *(F.when(F.col(a).isNotNull(), answer(a, f"{a}_attempt", a, 0)).alias(a) for a in CHAIN),
    )
    new = events.filter(F.col("kind").isin(OPEN, ANSWER)).select(
        "incident_id",
        F.when(asked, F.array("body")).otherwise(F.array().cast("array<string>")).alias("incidents"),
        F.lit(False).alias("done"),
        F.lit(None).cast("long").alias("fixed"),
        F.when(asked, clock).alias("asked"),
        F.when(~asked, clock).alias("answered"),
        *(F.when(F.col("agent") == a, answer(a, "attempt", "body", 1)).alias(a) for a in CHAIN),
    )
    # Of answers to the same attempt the one that was there before counts.
    met = old.unionByName(new).groupBy("incident_id").agg(
        F.flatten(F.collect_list("incidents")).alias("incidents"),
        F.bool_or("done").alias("done"),
        F.coalesce(*(F.min(c) for c in ("fixed", "asked", "answered"))).alias("deadline"),
        *(F.min(a).alias(a) for a in CHAIN),
    )
    state = met.select(
        "incident_id",
        "incidents",
        "done",
        "deadline",
        *(F.col(f"{a}.{part}").alias(n) for a in CHAIN for part, n in (("attempt", f"{a}_attempt"), ("body", a))),
    )
    found = F.size("incidents") > 0
    over = F.coalesce(F.col("deadline") + 1 < F.lit(moment), F.lit(False))
    outcome = (
        F.when(found & is_complete(), COMPLETE)
        .when(found & over, DEAD)
        .when(over & ~F.col("done"), ORPHAN)
    )
    return state.select("*", over.alias("over"), outcome.alias("outcome"))


def outcomes_of(events: DataFrame, met: DataFrame) -> DataFrame:
    """What a batch settles: lines that need no answers, and the incidents of ids with an outcome."""
    passed = events.filter(F.col("kind").isin(REJECTED, QUIET)).select(
        "incident_id",
        F.col("kind").alias("outcome"),
        F.col("body").alias("incident"),
        *(F.lit(None).cast("string").alias(a) for a in CHAIN),
    )
    ended = met.filter(F.col("outcome").isNotNull())
    return passed.unionByName(
        ended.select("incident_id", "outcome", F.explode_outer("incidents").alias("incident"), *CHAIN)
    )


def events_of(requests: DataFrame, attempts: DataFrame, clock: tuple[Column, Column], limit: int) -> DataFrame:
    """Requests after the log stage, and valid answers, as rows of one type."""
    intake = intake_of(requests.withColumn("_clock", clock[0]))
    kind = F.when(F.size("errors") > 0, REJECTED).when(~has_anchor(), QUIET).otherwise(OPEN)
    # A rejected line is no incident; its key keeps it apart from requests of the same id.
    name = F.when(F.size("errors") > 0, F.col("request_key")).otherwise(F.col("request_id"))
    none = F.lit(None).cast("string")
    asked = intake.select(
        name.alias("incident_id"),
        kind.alias("kind"),
        F.col("_clock").alias("clock"),
        none.alias("agent"),
        none.cast("int").alias("attempt"),
        F.to_json(F.struct(*[c for c in intake.columns if c != "_clock"])).alias("body"),
    )
    read = read_answers(attempts.withColumn("_clock", clock[1]), CHAIN)
    bodies = [
        F.when(F.col("agent") == name, F.to_json(F.struct(*[f.name for f in ANSWERS[name]], *USAGE))) for name in CHAIN
    ]
    valid = (F.size("errors") == 0) & F.col("attempt").between(1, limit) & F.col("incident_id").isNotNull()
    given = read.filter(valid).select(
        F.col("incident_id").cast("string").alias("incident_id"),
        F.lit(ANSWER).alias("kind"),
        F.col("_clock").alias("clock"),
        "agent",
        F.col("attempt").cast("int").alias("attempt"),
        F.coalesce(*bodies).alias("body"),
    )
    return asked.unionByName(given)


def start_late_triage(
    requests: DataFrame,
    attempts: DataFrame,
    rules: Rules,
    output: str,
    checkpoint: str,
    wait: str = "1 hour",
    every: str | None = None,
    clock: tuple[Column, Column] | None = None,
    limit: int = ATTEMPTS,
) -> StreamingQuery:
    """Reports as soon as all answers are there, dead letters ``wait`` after a request.

    ``requests`` are those of ``stream_requests``, ``attempts`` a stream of rows of
    ``schemas.ATTEMPT``.  Time is that of the batches; ``clock`` may give a
    column for either stream instead, which must not run backwards.  Besides the
    outputs of ``start_triage``, valid answers without a request go to ``output/orphans``.
    Of several valid answers of an agent the first attempt among those that are
    there when an incident is complete counts.
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    clock = clock or (F.current_timestamp(), F.current_timestamp())
    events = events_of(requests, attempts, clock, limit)
    body = intake_schema(requests)
    answers = {a: chain_schema(attempts, a) for a in CHAIN}

    def write_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = triage.BatchTables(spark, output, number)
        # Two sets of tables take turns: a batch that is run again finds what the one before it left.
        own, last = (triage.BatchTables(spark, f"{checkpoint}/waiting", n % 2) for n in (number, number - 1))
        arrived = own.write(batch, EVENTS)
        latest = arrived.select(F.unix_millis("clock").alias("moment"))
        before = spark.createDataFrame([], STATE)
        if number:
            latest = latest.unionByName(last.read(MOMENT, latest.schema))
            before = waiting(last.read(SETTLED, settled(before, arrived, wait_ms, 0).schema))
        moment = own.write(latest.agg(F.max("moment").alias("moment")), MOMENT).first().moment
        met = own.write(settled(before, arrived, wait_ms, moment), SETTLED)
        settled_rows = tables.write(outcomes_of(arrived, met), "outcomes")
        read = settled_rows.withColumn("incident", F.from_json("incident", body))
        read = read.withColumns({a: F.from_json(a, kind) for a, kind in answers.items()})
        quarantine = read.filter(F.col("outcome") == REJECTED).select("incident.*").select(*schemas.REJECTED)
        quarantine = tables.write(quarantine, triage.QUARANTINE)
        incidents = read.filter(F.col("outcome").isin(QUIET, COMPLETE)).select("incident.*")
        chains = read.filter(F.col("outcome") == COMPLETE).select("incident_id", *CHAIN).dropDuplicates(["incident_id"])
        reports = tables.write(all_reports(incidents, chains, rules), triage.REPORTS)
        tables.write(escalations(reports), triage.ESCALATIONS)
        dead = read.filter(F.col("outcome") == DEAD).select(
            F.col("incident.request_id").alias("incident_id"),
            "incident.service_name",
            "incident.incident_key",
            first_missing().alias("missing_agent"),
            F.lit(UNAVAILABLE).alias("detail"),
        )
        tables.write(dead, triage.UNAVAILABLE)
        tables.write(settled_rows.filter(F.col("outcome") == ORPHAN).select("incident_id", *CHAIN), ORPHANS)
        tables.commit(rows=settled_rows.count(), rejected=quarantine.count(), reports=reports.count())

    writer = events.writeStream.foreachBatch(write_batch)
    return triage.triggered(writer.option("checkpointLocation", checkpoint), every).start()


def intake_schema(requests: DataFrame):
    return intake_of(requests).schema


def chain_schema(attempts: DataFrame, agent: str):
    """Type of one agent's answer in a chain."""
    fields = [*(f.name for f in ANSWERS[agent]), *USAGE]
    return read_answers(attempts, [agent]).select(F.struct(*fields).alias("s")).schema["s"].dataType


def stream_attempts(spark, path: str, files_per_batch: int = 64) -> DataFrame:
    """Attempts as JSON lines in files that arrive in a folder, ids as text, with the place and time of their file."""
    schema = T.StructType([T.StructField("incident_id", T.StringType()), *schemas.ATTEMPT.fields[1:]])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived")]
    return reader.json(path).select(*schema.names, *place)
