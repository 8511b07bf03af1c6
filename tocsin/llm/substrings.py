"""Removal of repeated passages, by suffix automata of reference shards.

Every window of ``WINDOW`` words has an anchor: the k-gram with the smallest
hash in it, the last one where hashes tie.  Equal windows have equal anchors at
equal places, so windows can be dealt out by anchor, and consecutive windows
with one anchor travel as one segment of text.  Anchors that occur once end
there, as do those whose segments are all equal: their windows repeat.

Only the distinct segments of the other anchors are references.  An anchor's
segments make a shard: its suffix automaton, with occurrence counts, is built
in the task that streams the shard's segments for matching statistics, since
broadcasting all shards to all documents would grow with the square of the
corpus.  An anchor that occurs more than ``SEGMENTS`` times, which the first
aggregate tells, is never brought to one task: its segments are dealt out by
themselves and split into their windows, and the windows' hashes are counted by
an aggregate.  (Automata of parts of such an anchor would each have to see all
of its segments, which grows with their square.)
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.llm.shared import SLICE, arrow_mapped, mapped, stored, typed

# Words of a window and of an anchor, windows handled at one time, and segments of an anchor that is one automaton.
WINDOW, GRAM, PART, SEGMENTS = 35, 6, 1 << 18, 64


def word_hashes(text: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of words by their first and last eight bytes and their length.

    They only choose anchors, so words that share a hash do no harm.
    """
    padded = text + bytes(8)
    eight = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))
    size = stops - starts
    spare = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
    first = eight[starts] << spare
    last = eight[np.maximum(stops - 8, starts)] << spare
    total = first * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)
    total ^= total >> np.uint64(32)
    return total * np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    size = len(hashes) - width + 1
    total = hashes[:size].copy()
    for k in range(1, width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size]
        total ^= total >> np.uint64(31)
    return total * np.uint64(0xD6E8FEB86659FD93)


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """Place of the anchor of every window."""
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 20) - 1)  # parts are shorter
    least = (grams & ~low) | (low - places)
    width, span = 1, window - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return (low - (least & low)).astype(np.int64)


def parts(texts: list[bytes | None], window: int):
    """Texts with single blanks, put together or cut to about ``PART`` words.

    Yields lists of (number of the text, place of its first word, words).  The
    pieces of a long text share ``window - 1`` words, so each window is in one.
    """
    wait, size = [], 0
    for n, text in enumerate(texts):
        words = (text or b"").split()
        for start in range(0, max(len(words) - window + 1, 0), PART):
            wait.append((n, start, words[start : start + PART + window - 1]))
            size += len(wait[-1][2])
            if size >= PART:
                yield wait
                wait, size = [], 0
    if wait:
        yield wait


def segments(texts: list[bytes | None], window: int = WINDOW) -> list[tuple[np.ndarray, ...]]:
    """(number of the text, first word, number of windows, anchor hash, text hash) of all segments."""
    out = []
    for pieces in parts(texts, window):
        text = b" ".join([b" ".join(words) for _, _, words in pieces])
        sizes = np.array([len(words) for _, _, words in pieces])
        stops = np.r_[np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text)]
        starts = np.r_[0, stops[:-1] + 1]
        grams = gram_hashes(word_hashes(text, starts, stops), GRAM)
        at = anchors(grams, window)
        # Windows that reach from one text into the next are none.
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
        good = np.arange(len(at)) + window <= (begin + sizes)[owner]
        new = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]
        edges = np.flatnonzero(np.r_[new | ~good, True])
        first, number = edges[:-1], np.diff(edges)
        first, number = first[good[first]], number[good[first]]
        low, high = starts[first].tolist(), stops[first + number + window - 2].tolist()
        own = np.fromiter((xxhash.xxh64_intdigest(text[a:b], 2) for a, b in zip(low, high)), np.uint64, len(first))
        mine = owner[first]
        number_of, shift = (np.array([p[k] for p in pieces]) for k in (0, 1))
        out.append((number_of[mine], first - begin[mine] + shift[mine], number, grams[at[first]], own))
    return out


def doc_key(text):
    """Tells rows that share an id apart by their text; rows that share both are copies."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def all_segments(documents: DataFrame, window: int) -> DataFrame:
    """doc_id, th, first, number, anchor, seg of every segment of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", doc_key(F.col("text")).alias("th"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = segments(part.column(2).to_pylist(), window)
                if not found:
                    continue
                rows, first, number, anchor, own = (np.concatenate(c) for c in zip(*found))
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows),
                        part.column(1).take(rows),
                        pa.array(first.astype(np.int64)),
                        pa.array(number.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(own.view(np.int64)),
                    ],
                    ["doc_id", "th", "first", "number", "anchor", "seg"],
                )

    return arrow_mapped(rows, f"doc_id {kind}, th long, first long, number int, anchor long, seg long", run)


class Automaton:
    """Suffix automaton of some word sequences, with how often each state's words occur."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def add(self, words: list[bytes], times: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.count[last] += times

    def _extend(self, last: int, word: bytes) -> int:
        follow, link, length = self.next, self.link, self.length
        if word in follow[last]:
            old = follow[last][word]
            return old if length[old] == length[last] + 1 else self._copy(last, word, old)
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.count.append(0)
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            old = follow[at][word]
            link[new] = old if length[old] == length[at] + 1 else self._copy(at, word, old)
        return new

    def _copy(self, at: int, word: bytes, old: int) -> int:
        follow, link, length = self.next, self.link, self.length
        new = len(follow)
        follow.append(dict(follow[old]))
        link.append(link[old])
        length.append(length[at] + 1)
        self.count.append(0)
        link[old] = new
        while at >= 0 and follow[at].get(word) == old:
            follow[at][word] = new
            at = link[at]
        return new

    def settle(self) -> None:
        """Pass occurrence counts on from longer to shorter sequences."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeated(self, words: list[bytes], window: int) -> list[int]:
        """First words of the windows that occur twice or more, by matching statistics."""
        state, matched, out = 0, 0, []
        for place, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] > 1:
                out.append(place - window + 1)
        return out


def _judged(window: int):
    """Sorted (split, anchor, seg, n, text) rows to (anchor, seg, offset) of repeated windows.

    Rows of split anchors go out as window hashes, with their n, as they come.
    """

    def run(batches):
        group, wait, out = None, [], []

        def handed(anchor, seg, n, text):
            words = text.split()
            for offset in range(len(words) - window + 1):
                hashed = xxhash.xxh64_intdigest(b" ".join(words[offset : offset + window]), 3)
                out.append((anchor, seg, offset, struct.unpack("<q", struct.pack("<Q", hashed))[0], n))

        def settled():
            shard = Automaton()
            for _, _, n, text in wait:
                shard.add(text.split(), n)
            shard.settle()
            for anchor, seg, _, text in wait:
                out.extend((anchor, seg, offset, None, None) for offset in shard.repeated(text.split(), window))

        def packed():
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ["anchor", "seg", "offset", "hashed", "n"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for split, *row in zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns)):
                    if split:
                        handed(*row)
                        continue
                    if row[0] != group:
                        settled()
                        group, wait = row[0], []
                    wait.append(row)
                if len(out) > 4096:
                    yield packed()
                    out.clear()
        settled()
        yield packed()

    return run


def _covered(starts, window: int) -> list[tuple[int, int]]:
    """(first word, number of windows) runs as maximal (start, length) spans of words."""
    spans: list[list[int]] = []
    for first, number in sorted(starts):
        end = first + number + window - 1
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    return [(a, b - a) for a, b in spans]


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for start, length in spans:
        out += words[at:start]
        at = start + length
    return out + words[at:]


def deduplicated(documents: DataFrame, window: int = WINDOW, limit: int = SEGMENTS) -> DataFrame:
    """All columns of ``documents``, then what repeats in each row.

    Adds n_words, removed_spans (first word and number of words, maximal) and
    kept_text (the other words, joined by one blank).  Columns of these names
    are replaced.  A word goes if a window of ``window`` words over it starts at
    any other place of the table too, in the same row or another; windows are
    those of the input.  Null texts have no words and an empty kept_text; rows
    that repeat one another lose all words that such windows cover.
    """
    names = ("n_words", "removed_spans", "kept_text", "_th", "_runs", "_packed")
    base = documents.drop(*names)
    base = base.withColumn("_th", doc_key(F.col("text")))
    fields = base.schema.names
    position = [n.lower() for n in fields].index("text")
    kinds = base.schema.fields
    marks = stored(all_segments(documents, window), "substrings-segments")
    several = (
        marks.groupBy("anchor")
        .agg(F.count("*").alias("total"), F.min("seg").alias("least"), F.max("seg").alias("most"))
        .where("total > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("varied"), (F.col("total") > limit).alias("split"))
    )
    # Written first, so that both sides of the join are shuffled for it and Spark can split hot anchors.
    several = stored(several, "substrings-anchors")
    met = marks.join(several, "anchor")
    # Only segments still to be judged need a name.
    named = [F.when(F.col("varied"), F.col(n)).alias(n) for n in ("anchor", "seg", "split")]
    run = F.struct("first", "number", "varied", *named)
    lists = met.groupBy("doc_id", "th").agg(F.collect_set(run).alias("_runs"))
    lists = lists.withColumnsRenamed({"doc_id": "_doc", "th": "_key"})

    def packed():
        pack = zstandard.ZstdCompressor(3).compress

        def step(*row):
            text = row[position]
            data = None if text is None else pack(text.encode())
            return [(*row[:position], None, *row[position + 1 :], data)]

        return step

    # Texts cross both shuffles packed.
    base = mapped(base, T.StructType([*kinds, *typed("_packed binary").fields]), packed)
    joined = base.join(lists, base["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_key")), "left")
    joined = joined.drop("_doc", "_key")

    spans = "array<struct<start: long, length: long>>"
    more = typed(f"n_words long, removed_spans {spans}, kept_text string").fields

    def spanned(found):
        return [{"start": a, "length": n} for a, n in found]

    def first_pass():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(*row):
            data, runs = row[-2], row[-1] or []
            if any(r["varied"] for r in runs):
                return [(*row[:-2], None, None, None, data, runs)]
            whole = b"" if data is None else unpack(data)
            words = whole.split()
            found = _covered([(r["first"], r["number"]) for r in runs], window)
            left = (*row[:position], data if data is None else whole.decode(), *row[position + 1 : -2])
            return [(*left, len(words), spanned(found), b" ".join(_kept(words, found)).decode(), None, None)]

        return step

    runs_kind = "array<struct<first: long, number: int, varied: boolean, anchor: long, seg: long, split: boolean>>"
    later = typed(f"_packed binary, _runs {runs_kind}").fields
    read = stored(mapped(joined, T.StructType([*kinds, *more, *later]), first_pass), "substrings-first")
    done = read.where("_runs is null").drop("_runs", "_packed")
    unclear = read.where("_runs is not null")

    # One text for each distinct segment of an anchor whose segments differ.
    varied = unclear.select("doc_id", "_th", F.explode("_runs").alias("r")).where("r.varied").select("r.*", "doc_id", "_th")

    def cut():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(packed, runs):
            words = unpack(packed).split()
            return [
                (r["anchor"], r["seg"], r["split"], b" ".join(words[r["first"] : r["first"] + r["number"] + window - 1]))
                for r in runs
                if r["varied"]
            ]

        return step

    texts = mapped(unclear.select("_packed", "_runs"), "anchor long, seg long, split boolean, text binary", cut)
    shards = texts.groupBy("split", "anchor", "seg").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    dealt = F.when(F.col("split"), F.xxhash64("anchor", "seg")).otherwise(F.col("anchor"))
    shards = shards.withColumn("_dealt", dealt).repartition("_dealt").sortWithinPartitions("split", "anchor")
    shards = shards.select("split", "anchor", "seg", "n", "text")
    judged = arrow_mapped(shards, "anchor long, seg long, offset int, hashed long, n long", _judged(window))
    judged = stored(judged, "substrings-judged")
    handed = judged.where("hashed is not null")
    twice = handed.groupBy("anchor", "hashed").agg(F.sum("n").alias("times")).where("times > 1").drop("times")
    twice = stored(twice, "substrings-twice")
    clear = judged.where("hashed is null").select("anchor", "seg", "offset")
    clear = clear.unionByName(handed.join(twice, ["anchor", "hashed"], "left_semi").select("anchor", "seg", "offset"))
    clear = clear.groupBy("anchor", "seg").agg(F.collect_set("offset").alias("offsets"))
    # Written first, as above: a hot segment's rows can then be split.
    clear = stored(clear, "substrings-clear")
    starts = varied.join(clear, ["anchor", "seg"]).groupBy("doc_id", "_th").agg(
        F.collect_set(F.struct("first", "offsets")).alias("_found")
    )
    starts = starts.withColumnsRenamed({"doc_id": "_doc", "_th": "_key"})
    settled = F.expr("transform(filter(_runs, r -> not r.varied), r -> struct(r.first, r.number))")
    second = unclear.select(*[f"`{n}`" for n in fields], "_packed", settled.alias("_runs")).join(
        starts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_key")), "left"
    )

    def last_pass():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(*row):
            data = unpack(row[-3])
            words = data.split()
            own = [(r["first"], r["number"]) for r in row[-2]]
            own += [(f["first"] + o, 1) for f in row[-1] or [] for o in f["offsets"]]
            found = _covered(own, window)
            left = (*row[:position], data.decode(), *row[position + 1 : -3])
            return [(*left, len(words), spanned(found), b" ".join(_kept(words, found)).decode())]

        return step

    rest = mapped(second.drop("_doc", "_key"), T.StructType([*kinds, *more]), last_pass)
    return done.unionByName(rest).drop("_th")
