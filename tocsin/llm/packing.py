"""Packing token sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; full pieces are
sequences of their own.  The histogram of what is left (lengths rounded up to a
unit) is a cutting-stock problem: a linear program over patterns, whose columns
are priced by a knapsack dynamic program.  Its size depends on the sequence
length only, never on the number of documents.  Patterns are used a whole
number of times, first-fit-decreasing patterns take the rest, and documents,
ranked within their length class, take the places of the patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import arrow_mapped, mapped, stored
from tocsin.llm.vocabularies import ByteVocabulary

# Tokens of a sequence, tokens of a length class, and the id that ends a document.
LENGTH, UNIT, END = 1024, 4, 0


def knapsack(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Worth and counts of the best pattern; item k (from 0) takes k + 1 of ``room`` units."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for size in range(1, room + 1):
        worth = best[size - 1 :: -1][: len(prices)] + prices[:size]
        at = int(worth.argmax())
        if worth[at] > best[size - 1] + 1e-12:
            best[size], taken[size] = worth[at], at
        else:
            best[size] = best[size - 1]
    counts, left = np.zeros(len(prices), np.int64), room
    while left > 0:
        if taken[left] < 0:
            left -= 1
        else:
            counts[taken[left]] += 1
            left -= int(taken[left]) + 1
    return float(best[room]), counts


def fractional_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and uses that solve the linear program; one row for each class in demand."""
    rows = np.flatnonzero(demand)
    sizes = rows + 1
    columns = np.diag(room // sizes).astype(float)
    inverse, uses = np.diag(1.0 / (room // sizes)), demand[rows] / (room // sizes)
    for _ in range(20 * len(rows)):
        prices = np.zeros(room)
        prices[rows] = np.maximum(inverse.sum(axis=0), 0)
        worth, counts = knapsack(prices, room)
        if worth <= 1 + 1e-7:
            break
        entering = counts[rows].astype(float)
        change = inverse @ entering
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        uses = np.maximum(uses - step * change, 0)
        uses[out] = step
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        columns[:, out] = entering
    found = []
    for k in np.flatnonzero(uses > 0):
        full = np.zeros(len(demand), np.int64)
        full[rows] = columns[:, k].astype(np.int64)
        found.append((full, float(uses[k])))
    return found


def patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of uses that give every item of ``demand`` exactly one place.

    ``demand[k]`` items take k + 1 units each.  Uses of the linear program are
    rounded down; what is left is packed first fit decreasing.
    """
    left, found = demand.astype(np.int64).copy(), []
    if left.any():
        for counts, uses in fractional_patterns(left.astype(float), room):
            times = int(uses + 1e-6)
            times = min([times, *(left[counts > 0] // counts[counts > 0]).tolist()])
            if times > 0:
                found.append((counts, times))
                left -= times * counts
    while left.any():
        counts, free = np.zeros(len(left), np.int64), room
        for k in np.flatnonzero(left)[::-1]:
            counts[k] = min(left[k], free // (k + 1))
            free -= counts[k] * (k + 1)
        times = int((left[counts > 0] // counts[counts > 0]).min())
        found.append((counts, times))
        left -= times * counts
    return found


def tokenized(documents: DataFrame, path: str, length: int) -> DataFrame:
    """uid, doc_id, doc_tokens, pieces (ids as 4 bytes each): every document's pieces in order."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )

    def make():
        vocabulary, end = ByteVocabulary.of(path), np.array([END], "<u4").tobytes()

        def step(uid, doc, text):
            data = vocabulary.ids(text).astype("<u4").tobytes() + end
            return [(uid, doc, len(data) // 4, [data[k : k + 4 * length] for k in range(0, len(data), 4 * length)])]

        return step

    return mapped(rows, f"uid long, doc_id {kind}, doc_tokens long, pieces array<binary>", make)


def numbered(batches):
    """Batches whose last column, ids as 4 bytes each, becomes lists of numbers."""
    for batch in batches:
        data = [ids.as_py() for ids in batch.columns[-1]]
        ends = np.cumsum([0, *(len(ids) // 4 for ids in data)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4")))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], batch.schema.names)


def places(found: list[tuple[np.ndarray, int]]) -> tuple[list[tuple], int]:
    """(class, first rank, end rank, copies, first sequence, slot) of every pattern, and the number of sequences."""
    rows, ranks, sequence = [], {}, 0
    for counts, times in found:
        slot = 0
        for k in np.flatnonzero(counts)[::-1].tolist():
            first = ranks.get(k, 0)
            ranks[k] = first + int(counts[k]) * times
            rows.append((k + 1, first, ranks[k], int(counts[k]), sequence, slot))
            slot += int(counts[k])
        sequence += times
    return rows, sequence


def packed(documents: DataFrame, path: str, length: int = LENGTH, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``with_ids`` the piece's ids.  Either way the ids are written and
    brought to their places, and the checksum is that of the ids there.  A document's ids are those of the
    tokenizers library without added special tokens, then id 0; a null text is
    empty, so it is the id 0 alone.  Each row of the input is packed, also when
    it repeats another or has a null id.  Offsets have no gaps; a sequence is to
    be padded to ``length``.  An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = stored(tokenized(documents, path, length), "packing-tokens")
    full = F.floor(F.col("doc_tokens") / length)
    kind = F.ceil((F.col("doc_tokens") - full * length) / unit).cast("int")
    named = rows.drop("pieces").withColumn("full", full).withColumn("class", kind)

    room = length // unit
    demand = np.zeros(room, np.int64)
    for row in named.where("class > 0").groupBy("class").count().collect():  # at most ``room`` rows
        demand[row["class"] - 1] = row["count"]
    table, sequences = places(patterns(demand, room))

    # A rank among all pieces of a class: the task's offset, and a running sum within the task.
    parts = F.array(
        F.struct(F.lit(0).alias("class"), F.col("full").alias("n")),
        F.struct(F.col("class"), F.when(F.col("class") > 0, 1).otherwise(0).cast("long").alias("n")),
    )
    slim = named.select("uid", F.shiftright("uid", 33).alias("task"), F.explode(parts).alias("part"))
    slim = slim.select("uid", "task", "part.class", "part.n").where("n > 0")
    totals = slim.groupBy("class", "task").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("class", "task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("class", "task").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = slim.withColumn("_rank", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["class", "task"])
    ranked = ranked.select("uid", "class", "n", (F.col("_before") + F.col("_rank")).alias("rank"))

    columns = "class int, first long, end long, copies long, base long, slot long"
    place = spark.createDataFrame(table, columns)
    rest = ranked.join(F.broadcast(place), "class").where("rank >= first and rank < end")
    at = F.col("rank") - F.col("first")
    rest = rest.select(
        "uid",
        F.lit(True).alias("rest"),
        (F.col("base") + F.floor(at / F.col("copies"))).alias("sequence_id"),
        (F.col("slot") + at % F.col("copies")).alias("slot"),
    )
    whole = ranked.where("class = 0").select(
        "uid", F.lit(False).alias("rest"), (F.lit(sequences) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("slot")
    )
    cut = named.join(whole.unionByName(rest), "uid")
    number = F.sequence(F.lit(0).cast("long"), F.col("full") - 1)
    index = F.when(F.col("rest"), F.array(F.col("full"))).otherwise(number)
    pieces = cut.withColumn("k", F.explode(index)).select(
        "uid",
        "k",
        "doc_id",
        (F.col("k") * length).alias("start"),
        F.when(F.col("rest"), F.col("doc_tokens") - F.col("full") * length).otherwise(length).cast("long").alias("length"),
        "doc_tokens",
        (F.col("sequence_id") + F.when(F.col("rest"), 0).otherwise(F.col("k"))).alias("sequence_id"),
        "slot",
    )
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    # The ids cross one shuffle, when all places are known.
    ids = rows.select("uid", F.posexplode("pieces").alias("k", "ids")).withColumn("k", F.col("k").cast("long"))
    head = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    placed = pieces.join(ids, ["uid", "k"])
    if not with_ids:
        return placed.select(*head)
    placed = placed.select(*head, "ids")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.drop("ids").schema)
    return arrow_mapped(placed, f"{fields}, ids array<int>", numbered)
