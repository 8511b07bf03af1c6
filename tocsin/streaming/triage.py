"""Triage of a stream of requests, whose answers are there before them.

Every micro-batch runs the same functions as the batch job and overwrites its
own folders, named by the batch number, so a repeated batch replaces its
output.  A batch counts from the moment its marker is written, after all its
other tables; readers see whole batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tocsin import schemas
from tocsin.operators.answers import unavailable
from tocsin.operators.governance import Rules
from tocsin.operators.reports import all_reports, escalations
from tocsin.plans.triage import accepted_of, anchored_of, intake_of

# Tables of a batch, and the one whose rows say that a batch is whole.
REPORTS, ESCALATIONS, UNAVAILABLE, QUARANTINE = "reports", "escalations", "unavailable", "quarantine"
INTAKE, COMMITS = "intake", "commits"


class BatchTables:
    """The tables that one micro-batch writes below a folder."""

    def __init__(self, spark: SparkSession, output: str, number: int):
        self.spark, self.output, self.number = spark, output, number

    def write(self, rows: DataFrame, kind: str) -> DataFrame:
        """Replace the batch's table of a kind; returns it as read back, so that nothing is worked out twice."""
        rows.write.mode("overwrite").parquet(self.path(kind))
        return self.read(kind, rows.schema)

    def path(self, kind: str) -> str:
        return f"{self.output}/{kind}/batch={self.number}"

    def read(self, kind: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(kind))

    def commit(self, **counts: int) -> None:
        columns = ", ".join(f"{name} long" for name in counts)
        self.write(self.spark.createDataFrame([tuple(counts.values())], columns), COMMITS)


def committed(spark: SparkSession, output: str, kind: str) -> DataFrame:
    """Rows of one kind from all whole batches, with the number of their batch."""
    whole = spark.read.parquet(f"{output}/{COMMITS}").select(F.col("batch").alias("_batch"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{output}/{kind}")
    return rows.join(whole, F.col("batch") == F.col("_batch"), "left_semi")


def rejected(intake: DataFrame) -> DataFrame:
    """Lines that are no requests: their place, size, payload's digest and reasons."""
    return intake.filter(F.size("errors") > 0).select(*schemas.REJECTED)


def triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """Run over what is there and stop, or start a batch ``every`` so often."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def start_triage(
    requests: DataFrame, chains: DataFrame, rules: Rules, output: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Run over what is there, then stop, or go on ``every`` so often; a restart continues where it ended.

    ``requests`` are those of ``stream_requests``.  ``chains`` is a static table
    of agent chains (a written one, since every micro-batch reads it); for
    answers that arrive later see ``tocsin.streaming.answers``.  Reports go to
    ``output/reports``, messages about blocked commands to ``output/escalations``,
    incidents whose agents failed to ``output/unavailable`` and lines that are no
    requests to ``output/quarantine``: accepted and rejected ones are all lines.
    """

    # Ids of requests are texts.
    chains = chains.withColumn("incident_id", F.col("incident_id").cast("string"))

    def write_batch(batch: DataFrame, number: int) -> None:
        tables = BatchTables(batch.sparkSession, output, number)
        intake = tables.write(intake_of(batch), INTAKE)
        quarantine = tables.write(rejected(intake), QUARANTINE)
        incidents = accepted_of(intake)
        reports = tables.write(all_reports(incidents, chains, rules), REPORTS)
        tables.write(escalations(reports), ESCALATIONS)
        tables.write(unavailable(anchored_of(incidents), chains), UNAVAILABLE)
        tables.commit(lines=intake.count(), rejected=quarantine.count(), reports=reports.count())

    writer = requests.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return triggered(writer, every).start()
