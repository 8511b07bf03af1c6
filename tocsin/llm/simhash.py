"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most four of 64 bits differ in at most one
bit of some third of them.  So every distinct fingerprint is put under 64 keys:
for each bit, the segment around that bit with the bit masked out.  Fingerprints
under one key are compared, and links become connected components.  Copies with
the same fingerprint are one node, however many there are.

Keys are dealt out by hash and streamed in sorted order.  A key with more than
``BLOCK`` fingerprints is handed on, cut into blocks, and every pair of blocks
is compared in a task of its own.  A key never sends all its pairs on: of a few
fingerprints the links, of many a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.components import components
from tocsin.llm.shared import arrow_mapped, mapped, stored

# First bit and width of each segment; words of a shingle; bits that linked fingerprints may differ in.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
WORDS, DISTANCE = 4, 4
# Fingerprints of a key that are compared at one time, and up to which pairs are compared one by one.
BLOCK, FEW = 8_192, 12
WINDOWS = 65_536


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(WORDS, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for start in range(0, total, WINDOWS):
        stop = min(total, start + WINDOWS)
        runs = zip(*(words[start + k : stop + k] for k in range(width)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs), np.uint64, stop - start)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > total))


def fingerprints(documents: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``kept`` and fp (the fingerprint as a signed long) of every row."""
    kinds = ", ".join(f"{name} {documents.schema[name].dataType.simpleString()}" for name in kept)
    texts = documents.select(*kept, F.col("text").cast("binary").alias("text"))

    def make():
        return lambda *row: [(*row[:-1], (v := fingerprint(row[-1])) - (v >> 63 << 64))]

    return mapped(texts, f"{kinds}, fp long", make)


def signatures(prints: DataFrame) -> DataFrame:
    """key, fp: each fingerprint under its 64 one-wildcard keys."""
    bit = F.col("bit")
    key = F.lit(None).cast("long")
    for first, width in reversed(SEGMENTS):
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        kept = segment.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, bit - {first})")))
        key = F.when(bit >= first, kept) if first == SEGMENTS[-1][0] else F.when(bit < first + width, kept).otherwise(key)
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return rows.select(F.shiftleft(bit.cast("long"), 22).bitwiseOR(key).alias("key"), "fp")


def _chosen(left: np.ndarray, right: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether ``bit`` is the first key under which linked fingerprints meet."""
    differ = left ^ right
    want = np.full(len(left), -1)
    for first, width in reversed(SEGMENTS):
        part = (differ >> np.uint64(first)) & np.uint64((1 << width) - 1)
        count = np.bitwise_count(part)
        place = np.bitwise_count(np.maximum(part, np.uint64(1)) - np.uint64(1))
        want = np.where(count == 0, first, np.where(count == 1, first + place, want))
    return want == bit


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that span every component of some distinct fingerprints.

    Rows outside the largest component so far are compared with all rows, a
    block at a time, until no such row is left uncompared.
    """
    size = len(prints)
    label, compared, links = np.arange(size), np.zeros(size, bool), []
    while True:
        counts = np.bincount(label, minlength=size)
        rest = np.flatnonzero((label != counts.argmax()) & ~compared)[:64]
        if not len(rest):
            return links
        for at in rest:
            compared[at] = True
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[at]) <= DISTANCE)
            found, places = np.unique(label[near], return_index=True)
            if len(found) > 1:
                links += [(int(prints[at]), int(prints[near[p]])) for f, p in zip(found, places) if f != label[at]]
                label[np.isin(label, found)] = found[0]


def _links(keys: np.ndarray, prints: np.ndarray, block: int, whole: bool):
    """Links (a, b) among sorted keys, and (key, fp) of keys with more than ``block`` rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b, over = [], [], []
    small = np.repeat(sizes <= FEW, sizes)
    for step in range(1, FEW):
        at = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else []
        if not len(at):
            break
        left, right = prints[at], prints[at + step]
        near = np.bitwise_count(left ^ right) <= DISTANCE
        left, right, bit = left[near], right[near], (keys[at[near]] >> 22)
        good = _chosen(left, right, bit) if not whole else np.ones(len(left), bool)
        a.append(left[good])
        b.append(right[good])
    for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        rows = prints[start : start + size]
        if size > block and not whole:
            over.append((keys[start : start + size], rows))
        elif found := forest(np.unique(rows)):
            pairs = np.array(found, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return a, b, over


def _scan(block: int, whole: bool):
    """Compare sorted (key, fp) batches; rows out: a, b, and key where the key is handed on.

    A key's rows wait until the next key begins, up to ``block`` of them; rows
    of a longer key go out at once.
    """

    def out(a, b, key=None):
        a, b = (np.ascontiguousarray(x).view(np.int64) for x in (a, b))
        key = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), key], ["a", "b", "key"])

    def run(batches):
        keys, prints, long = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def settle(keys, prints):
            a, b, over = _links(keys, prints, block, whole)
            if a and sum(map(len, a)):
                yield out(np.concatenate(a), np.concatenate(b))
            for k, rows in over:
                yield out(rows, rows, k)

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            p = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if long is not None:  # more rows of a key that is being handed on
                stop = int(np.searchsorted(k, long, "right"))
                if stop:
                    yield out(p[:stop], p[:stop], k[:stop])
                k, p = k[stop:], p[stop:]
                if not len(k):
                    continue
                long = None
            keys, prints = np.concatenate([keys, k]), np.concatenate([prints, p])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            yield from settle(keys[:last], prints[:last])
            keys, prints = keys[last:].copy(), prints[last:].copy()
            if len(keys) > block and not whole:
                long = keys[0]
                yield out(prints, prints, keys)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield from settle(keys, prints)

    return run


def linked(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: links that connect exactly the fingerprints a chain of near ones connects."""
    dealt = signatures(prints).repartition("key").sortWithinPartitions("key")
    found = stored(arrow_mapped(dealt, "a long, b long, key long", _scan(block, False)), "simhash-links")
    links = found.where("key is null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    over = found.where("key is not null").select("key", F.col("a").alias("fp"))
    blocks = over.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(block)).cast("int").alias("n"))
    cut = over.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    cells = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp"
    )
    dealt = cells.repartition("key").sortWithinPartitions("key")
    more = arrow_mapped(dealt, "a long, b long, key long", _scan(block, True))
    return links.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _rooted(classes: DataFrame, block: int) -> DataFrame:
    """The rows (fp, first) of distinct fingerprints, with the root of each one's component."""
    roots = components(linked(classes.select("fp"), block), "simhash-stars")
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    ``component_id`` is the smallest doc_id that a chain of fingerprints within
    four bits reaches.  A null text, like one without words, has fingerprint
    zero and is linked like any other.  Rows that repeat a doc_id stay rows of
    their own; a null doc_id is never the smallest unless there is no other.
    Other columns are not looked at.
    """
    rows = stored(fingerprints(documents), "simhash-prints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    named = _rooted(classes, block)
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = named.join(groups, "root").select("fp", "component_id")
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each component of near copies, columns as they are.

    It is the one with the smallest doc_id; rows without an id come last.  Of
    rows that share an id within a component the one with the smallest text
    hash stays.  Rows of other components stay whatever their ids are.
    """
    # Written with a number of its own for each row: ids may repeat or be null.
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row"))
    rows = stored(rows, "simhash-rows")
    keyed = rows.select("uid", "row.doc_id", F.xxhash64("row.text").alias("th"), "row.text")
    prints = stored(fingerprints(keyed, ("doc_id", "th", "uid")), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "uid")
    classes = stored(prints.groupBy("fp").agg(F.min(order).alias("first")), "simhash-classes")
    chosen = _rooted(classes, block).groupBy("root").agg(F.min("first").alias("first")).select("first.uid")
    return rows.join(chosen, "uid", "left_semi").select("row.*")
