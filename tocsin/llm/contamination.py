"""Benchmark passages in documents, by a broadcast hash set of word windows.

The benchmark's windows are broadcast in shards of at most ``SHARD`` bytes of
item text.  A shard is a few flat arrays: 4 bytes for each word, 16 for each
different window and 4 for each of its items, and a number for each different
word; about 8 bytes for each byte of text.  With one shard the documents are
scanned once and nothing is shuffled.  With several, one shard after the other is
broadcast and scanned for, so a worker holds one at a time; only the rows that a
shard hits are written, and joined to the documents in the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.llm.shared import mapped, set_apart, stored, typed

# Words of a window, and bytes of item text in one broadcast.
WINDOW, SHARD = 13, 16 << 20
# Words are digits, letters a to z and all that is not ASCII; A to Z become a to z.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Sized:
    """The different windows of one length: sorted hashes, where each stands, and the items that have it."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, owners: np.ndarray, size: int):
        self.size, self.seed = size, 0
        while True:  # until no two different windows share a hash
            hashes = self.hashes_of(ids, starts)
            order = np.lexsort((owners, hashes))
            first = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0])
            places = np.repeat(starts[order][first], np.diff(np.r_[first, len(order)]))
            if self.equal(ids, starts[order], ids, places).all():
                break
            self.seed += 1
        new = np.r_[True, (np.diff(hashes[order]) != 0) | (np.diff(owners[order]) != 0)]
        self.hashes, self.places = hashes[order][first], starts[order][first].astype(np.int32)
        self.owners = owners[order][new].astype(np.int32)
        self.offsets = np.r_[np.cumsum(new)[first] - 1, len(self.owners)].astype(np.int32)

    def hashes_of(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = ids[starts].astype(np.uint64) + np.uint64(self.seed)
        with np.errstate(over="ignore"):
            for k in range(1, self.size):
                total = total * np.uint64(0x9E3779B97F4A7C15) + ids[starts + k].astype(np.uint64)
                total ^= total >> np.uint64(29)
        return total

    def equal(self, ids: np.ndarray, starts: np.ndarray, others: np.ndarray, places: np.ndarray) -> np.ndarray:
        same = np.ones(len(starts), bool)
        for k in range(self.size):
            same &= ids[starts + k] == others[places + k]
        return same


class Windows:
    """Windows of some items: word numbers, then for each length the windows as flat arrays."""

    def __init__(self, items: list[tuple[object, bytes | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.items, words = [], []
        for item, text in items:
            own = words_of(text)
            if own:
                self.items.append(item)
                words.append(np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for w in own), np.int32, len(own)))
        self.ids = np.concatenate([*words, np.zeros(0, np.int32)])
        lengths = np.array([len(w) for w in words], np.int64)
        begin, sizes = np.cumsum(lengths) - lengths, np.minimum(lengths, width)
        self.sized = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            number = lengths[own] - size + 1
            starts = np.repeat(begin[own] - (np.cumsum(number) - number), number) + np.arange(number.sum())
            self.sized.append(Sized(self.ids, starts, np.repeat(own, number), size))

    def held(self) -> int:
        """Bytes of the arrays, and about those of the words."""
        arrays = [self.ids, *(a for s in self.sized for a in (s.hashes, s.places, s.owners, s.offsets))]
        return sum(a.nbytes for a in arrays) + sum(len(w) + 120 for w in self.numbers)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal hit spans (first word, number of words) and the items with occurring windows."""
        number = self.numbers.get
        ids = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
        known = np.r_[0, np.cumsum(ids != 0)]
        spans, items = [], set()
        for sized in self.sized:
            size = sized.size
            starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else []
            if not len(starts):
                continue
            found = sized.hashes_of(ids, starts)
            at = np.minimum(np.searchsorted(sized.hashes, found), len(sized.hashes) - 1)
            hit = sized.hashes[at] == found
            starts, at = starts[hit], at[hit]
            same = sized.equal(ids, starts, self.ids, sized.places[at])
            spans += [(start, start + size) for start in starts[same].tolist()]
            for window in np.unique(at[same]).tolist():
                items.update(sized.owners[sized.offsets[window] : sized.offsets[window + 1]].tolist())
        return merged(spans), {self.items[n] for n in items}


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) spans as maximal (start, length) spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b - a) for a, b in out]


def _shards(benchmark: DataFrame, limit: int) -> list:
    """Functions that give benchmark rows, in groups of about ``limit`` bytes, or one item where that is longer."""
    sized = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = 1 + 2 * total // limit if total > limit else 1

    def rows(shard: int) -> list:
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == shard) if number > 1 else sized
        return [(r.item_id, r.text and bytes(r.text)) for r in part.toLocalIterator()]

    return [lambda shard=shard: rows(shard) for shard in range(number)]


def _searched(frame: DataFrame, position: int, items: list, width: int, fields: T.StructType) -> DataFrame:
    """All columns, the number of words, the hit spans and the items, as text, of one shard."""
    sent = frame.sparkSession.sparkContext.broadcast(Windows(items, width))

    def make():
        windows = sent.value

        def step(*row):
            words = words_of((row[position] or "").encode())
            spans, owners = windows.find(words)
            names = sorted({"null" if o is None else str(o) for o in owners})
            return [(*row, len(words), [{"start": a, "length": n} for a, n in spans], names)]

        return step

    return mapped(frame, fields, make)


def _joined(spans) -> list[tuple[int, int]]:
    """Spans of several shards as maximal ones; only rows with hits come here."""
    return merged([(s["start"], s["start"] + s["length"]) for s in spans])


def scan(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, limit: int = SHARD) -> DataFrame:
    """All columns of ``documents``, then what was found in each row.

    Adds n_words, n_hit, hit_spans (first word and number of words, maximal),
    hit_items (item ids as text, sorted as strings) and contaminated (some word
    is hit, and at least one in twenty).  Columns of these names are replaced.
    A document word is hit if it lies in an occurrence of ``width`` consecutive
    item words, or of a whole shorter item; null texts and items without words
    give nothing.  Repeated items count once per id, a null item id is the text
    ``null``.
    """
    base = documents.drop("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")
    names = [f"`{c}`" for c in base.columns]
    position = [c.lower() for c in base.columns].index("text")
    kinds = typed("_words long, _spans array<struct<start: long, length: long>>, _items array<string>")
    shards = _shards(benchmark, limit)
    if len(shards) == 1:
        found = _searched(base, position, shards[0](), width, T.StructType([*base.schema.fields, *kinds.fields]))
    else:
        rows = stored(base.withColumn("_uid", F.monotonically_increasing_id()), "contamination-rows")
        hits = rows.select("_uid").where("false").select("_uid", *(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds))
        texts = rows.select("_uid", rows.columns[position])
        fields = T.StructType([rows.schema["_uid"], rows.schema[position], *kinds.fields])
        for items in shards:
            one = _searched(texts, 1, items(), width, fields).where(F.size("_items") > 0)
            hits = hits.unionByName(stored(one.drop(rows.columns[position]), "contamination-hits"))
        merged_spans = F.udf(_joined, kinds["_spans"].dataType)
        hits = hits.groupBy("_uid").agg(
            F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items")
        )
        counted = _searched(rows, position, [], width, T.StructType([*rows.schema.fields, *kinds.fields]))
        found = counted.drop("_spans", "_items").join(hits.withColumn("_spans", merged_spans("_spans")), "_uid", "left")
        none = [F.coalesce(c, F.array().cast(kinds[c].dataType)).alias(c) for c in ("_spans", "_items")]
        found = found.select(*names, "_words", none[0], F.array_sort(none[1]).alias("_items"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        *[f"`{c}`" for c in base.columns],
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.col("_spans").alias("hit_spans"),
        F.col("_items").alias("hit_items"),
        ((hit > 0) & (20 * hit >= F.col("_words"))).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """The documents without contaminated rows, or with the hit words cut out.

    ``remove="documents"`` drops rows that :func:`scan` calls contaminated;
    ``remove="spans"`` keeps all rows and cuts, from the first byte of the first
    to the last byte of the last hit word, every hit span.  Columns stay as
    they are.
    """
    apart, restored = set_apart(documents)
    found = scan(apart, benchmark)
    if remove == "documents":
        return restored(found.where(~F.col("contaminated")))
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")

    fields = [f for f in apart.schema if f.name.lower() != "text"]
    text = T.StructField("text", T.StringType())
    order = [f"`{f.name}`" for f in fields]

    def cut():
        return lambda text, spans, *rest: [(without(text, [(s["start"], s["length"]) for s in spans]), *rest)]

    return restored(mapped(found.select("text", "hit_spans", *order), T.StructType([text, *fields]), cut))


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the given spans of its words."""
    if not text or not spans:
        return text
    data = text.encode()
    inside = np.frombuffer(data.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for start, length in spans:
        out.append(data[at : starts[start]])
        at = ends[start + length - 1]
    return b"".join([*out, data[at:]]).decode()

