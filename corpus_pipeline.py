"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import contamination, langid, packing, simhash, substrings
from tocsin.llm.queries import table, vocabulary
from tocsin.llm.shared import Scratch, set_apart, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Share of the best language below which a text is in none of the learnt ones.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters go."""
    return langid.accepted(docs, langid.fitted(docs), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without repeated passages; a text that has none stays as it is."""
    apart, restored = set_apart(docs)
    found = substrings.deduplicated(apart)
    whole = F.size("removed_spans") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept_text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        name = apart.columns[docs.columns.index("n_chars")]
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn(name, F.when(whole, F.col(name)).otherwise(size))
    return restored(found)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    return contamination.decontaminate(docs, table(spark, folder, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of 1,024 tokens."""
    return packing.packed(docs, vocabulary(), with_ids=True)


def in_order(*stages: tuple[str, Stage]) -> list[tuple[str, Stage]]:
    """The stages, each of which first removes the tables that the one before it wrote on its way.

    A stage is given what its predecessor's written result says, so the predecessor's own
    tables are read no more; those that its input does read stay.
    """

    def after(before: Scratch | None, own: Scratch, stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
            if before:
                before.clear(docs)
            with own:
                return stage(spark, docs, folder)

        return run

    left = [Scratch() for _ in stages]
    return [(name, after(left[n - 1] if n else None, left[n], stage)) for n, (name, stage) in enumerate(stages)]


STAGES = in_order(
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("benchmark", benchmark),
    ("packing", sequences),
)

# Fingerprints, kernels and token ids are beyond SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages; each one's rows are written before the next reads them."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
