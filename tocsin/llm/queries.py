"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import (
    alignment,
    chat,
    contamination,
    curriculum,
    langid,
    lm,
    packing,
    quality,
    simhash,
    substrings,
    tokens,
    trie,
    warc,
)
from tocsin.llm.shared import stored
from tocsin.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), vocabulary())


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


# A conversation whose texts look like the template, added to the table.
INJECTED = """
SELECT * FROM VALUES
    (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
AS t (conv_id, turn, role, text)
"""


def op3_chat_formats(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat.formatted_chats(chat.turns_as_tree(conversations.unionByName(spark.sql(INJECTED))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chat.read_back(chats).select(F.col("tree").try_cast("long").alias("conv_id"), "formatted", "turns", "loss")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_warc_records(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    read = warc.read_archives(spark, path)
    full = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_languages(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fitted(documents.where(langid.remainder(documents, 4) != 2))
    found = langid.identified(documents.select("doc_id", "text"), model)
    held = F.coalesce(langid.remainder(found, 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), vocabulary())


def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op10_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(langid.remainder(documents, 7) == 2, F.lit(False))
    found = lm.scored(documents.withColumn("training", ~held), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (~F.col("training")).alias("held_out"), *found.columns[2:])


def op11_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    passes = curriculum.curriculum(table(spark, folder, "documents").select("doc_id", "source", "text"))
    words = F.coalesce(F.regexp_count("text", F.lit(curriculum.WORD)), F.lit(0)).cast("long")
    found = passes.groupBy("uid", "doc_id", "size", "source_size", "target").agg(
        F.sum(words).alias("taken"), F.min("position").alias("first_position")
    )
    return found.drop("uid")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.token_alignment(documents, vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = stored(trie.numbered_turns(table(spark, folder, "conversations")), "trie-numbered")
    return trie.prefix_trie(*trie.with_heads(turns, every=20, most=4))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
