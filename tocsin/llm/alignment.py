"""Alignment of the tokens of two vocabularies, by runs along a diagonal.

A text's tokens in either vocabulary end at ascending byte offsets.  Offsets
where both end cut the text into groups.  Most groups are one token against
one: while that holds, the two arrays of ends are equal at a constant shift of
index.  Stretches of such groups are jumped by probing blocks of doubling length at the
current shift; the group that breaks a stretch is resolved by stepping the
token that ends first, which gives the next shift.

Pairs of ids that overlap are counted by documents over the whole corpus.  Each
document's links then look their counts up in two tiers: pairs of a fixed
number, the most frequent ones, come in a broadcast table; the others, none of
which can be hot, are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import arrow_mapped, least_power, mapped, stored
from tocsin.llm.vocabularies import ByteVocabulary, PieceVocabulary

# Characters of a text that are aligned at one time, and a blank at which no vocabulary joins two tokens.
SECTION = 1 << 16
SINGLE = re.compile(r"(?<=\S) (?=\S)")
# Places of a stretch that are compared one by one before blocks are.
NEAR = 8
# Pairs in the broadcast tier, 17 bytes each, and links of a long text that are held before they are added up.
FREQUENT, HELD = 1 << 16, 1 << 20


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """Parts of a text that single blanks join; a part has ``size`` characters, and what is left of a word.

    A pre-token of the byte vocabulary begins with such a blank, and no entry of the
    piece vocabulary has a blank behind another character, so the tokens of
    " " + part, one part after the other, are those of " " + text.
    """
    start = 0
    while len(text) - start > size and (cut := SINGLE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def stretch(ends_a: list[int], ends_b: list[int], i: int, j: int) -> int:
    """Number of equal ends from places i and j on: blocks of doubling length, then halves of the one that differs."""
    limit, step, same = min(len(ends_a) - i, len(ends_b) - j), 1, 0

    def equal(low: int, high: int) -> bool:
        return ends_a[i + low : i + high] == ends_b[j + low : j + high]

    while same < limit:
        end = min(same + step, limit)
        if not equal(same, end):
            while end - same > 1:
                half = (same + end) // 2
                if equal(same, half):
                    same = half
                else:
                    end = half
            return same
        same, step = end, 2 * step
    return same


def irregular(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """Groups of more than one token on a side, and the places on either side of their links.

    A group is given by its first place and the place behind it on either side;
    all other groups are one token against one.  The last ends are equal.
    """
    groups, left, right = [], [], []
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    while True:
        # Most stretches are short: their first places are compared one by one.
        near = min(i + NEAR, n, m + i - j)
        while i < near and ends_a[i] == ends_b[j]:
            i += 1
            j += 1
        if i == near:
            same = stretch(ends_a, ends_b, i, j)
            i, j = i + same, j + same
            if i == n:
                return groups, left, right
        x, y = i, j
        a, b = ends_a[x], ends_b[y]
        left.append(x)
        right.append(y)
        while a != b:
            if a < b:
                x += 1
                a = ends_a[x]
            else:
                y += 1
                b = ends_b[y]
            left.append(x)
            right.append(y)
        groups.append((i, x + 1, j, y + 1))
        i, j = x + 1, y + 1


def firsts(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Places from 0 to n - 1 without those that lie in a range, but for the range's first."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts + 1, 1)
    np.add.at(change, stops, -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


class Spelling:
    """Texts for numbers; those of many numbers come as one buffer."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.lengths = pa.array(texts, pa.large_binary()), np.array([len(t) for t in texts], np.int64)

    def of(self, numbers: np.ndarray) -> bytes:
        return self.texts.take(pa.array(numbers)).buffers()[2].to_pybytes() if len(numbers) else b""


class Links:
    """Distinct pairs of ids, as numbers, with how often each is linked; added up whenever many are held."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append((codes, np.ones(len(codes), np.int64)))
        self.held += len(codes)
        if self.held > HELD:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in self.parts])
        times = np.concatenate([t for _, t in self.parts])
        found, place = np.unique(codes, return_inverse=True)
        return found, np.bincount(place, times, len(found)).astype(np.int64)


class Aligner:
    """Tokens, groups and links of whole texts."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.a, self.b = ByteVocabulary.of(bytes_path), PieceVocabulary.of(pieces_path)
        self.width = len(self.b.bytes)
        sides = [[v.bytes.get(n, b"") for n in range(max(v.bytes) + 1)] for v in (self.a, self.b)]
        self.bytes = [Spelling(texts) for texts in sides]
        # A number, and what follows it in the text of the groups.
        self.numbers = Spelling([b"%d%c" % (n, sign) for n in range(max(map(len, sides))) for sign in b",|;"])

    def _side(self, side: int, ids: np.ndarray, raw: bytes) -> np.ndarray | None:
        """Ends of the tokens, or None where they do not spell the text."""
        ends = np.cumsum(self.bytes[side].lengths[ids])
        return ends if len(ids) and ends[-1] == len(raw) and self.bytes[side].of(ids) == raw else None

    def section(self, text: str) -> tuple[list[int], bytes, np.ndarray] | None:
        """n_a, n_b, n_groups and n_links; the groups as text, each with a semicolon behind it; the pair of every link."""
        raw = b" " + text.encode()
        a, b = self.a.plain_ids(" " + text), self.b.plain_ids(text)
        ends_a, ends_b = self._side(0, a, raw), self._side(1, b, raw)
        if ends_a is None or ends_b is None:
            return None
        groups, left, right = irregular(ends_a.tolist(), ends_b.tolist())
        start_a, stop_a, start_b, stop_b = np.array(groups, np.int64).reshape(-1, 4).T
        first_a, first_b = firsts(len(a), start_a, stop_a), firsts(len(b), start_b, stop_b)
        next_a, next_b = np.r_[first_a[1:], len(a)], np.r_[first_b[1:], len(b)]
        spelt = np.empty(len(a) + len(b), np.int64)
        follow = 3 * a
        follow[next_a - 1] += 1
        spelt[np.arange(len(a)) + np.repeat(first_b, next_a - first_a)] = follow
        follow = 3 * b
        follow[next_b - 1] += 2
        spelt[np.arange(len(b)) + np.repeat(next_a, next_b - first_b)] = follow
        single = (next_a - first_a == 1) & (next_b - first_b == 1)
        pairs = np.r_[a[first_a[single]] * self.width + b[first_b[single]], a[left] * self.width + b[right]]
        return [len(a), len(b), len(first_a), len(pairs)], self.numbers.of(spelt), pairs

    def document(self, text: str | None) -> tuple | None:
        """n_a, n_b, n_groups, n_links, digest of the groups, pairs, links of each; None without tokens."""
        if not text:
            return None
        digest, links, totals, wait = hashlib.sha256(), Links(), np.zeros(4, np.int64), b""
        for part in sections(text):
            found = self.section(part)
            if found is None:
                return None
            digest.update(wait + found[1][:-1])
            links.add(found[2])
            totals, wait = totals + found[0], b";"
        return *totals.tolist(), digest.hexdigest(), *links.total()


def alignments(documents: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Every document's tokens, groups and distinct links.

    Returns uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a's
    id times the size of b's vocabulary, plus b's id) and links, the
    occurrences of each pair.  A text that is null, empty, or not spelt by
    the tokens' bytes has no tokens: zeros, an empty digest and no pairs.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")

    def make():
        aligner = Aligner(bytes_path, pieces_path)
        return lambda uid, doc, text: [(uid, doc, *(aligner.document(text) or (0, 0, 0, 0, "", [], [])))]

    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return mapped(rows, f"uid long, doc_id {kind}, {counts}, pairs array<long>, links array<long>", make)


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """pair, n, best: documents that hold a pair linked, and whether no pair of its first id is in more.

    A first id has at most ``width`` pairs, which bounds the groups of the window.
    """
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    rivals = Window.partitionBy(F.floor(F.col("pair") / width))
    return counts.withColumn("best", F.col("n") == F.max("n").over(rivals))


def frequent_pairs(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``size`` pairs, those in so many documents or more; sorted, with n and best."""
    least = least_power(counts, "n", size)
    top = sorted(counts.where(F.col("n") >= 2.0**least).collect())
    kinds = (np.int64, np.int64, np.bool_)
    return tuple(np.array([r[k] for r in top], kind) for k, kind in enumerate(kinds))


def looked_up(found: DataFrame, frequent: tuple) -> DataFrame:
    """Sums over the links of frequent pairs, n_best and count_sum, and the pairs and links that are left."""
    table = found.sparkSession.sparkContext.broadcast(frequent)
    kept = [c for c in found.columns if c not in ("pairs", "links")]

    def run(batches):
        known, n, best = table.value
        for batch in batches:
            lists, columns = batch.column("pairs"), [batch.column(c) for c in kept]
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            pairs = lists.flatten().to_numpy(zero_copy_only=False)
            links = batch.column("links").flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            where, rest = at[hit], np.flatnonzero(~hit)
            np.add.at(sums[0], rows[hit], links[hit] * best[where])
            np.add.at(sums[1], rows[hit], links[hit] * n[where])
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[rest], minlength=batch.num_rows))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rest], pa.int64())) for x in (pairs, links)]
            arrays = [*columns, pa.array(sums[0]), pa.array(sums[1]), *left]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "n_best", "count_sum", "pairs", "links"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*kept).schema)
    return arrow_mapped(found, f"{fields}, n_best long, count_sum long, pairs array<long>, links array<long>", run)


def token_alignment(documents: DataFrame, bytes_path: str, pieces_path: str, frequent: int = FREQUENT) -> DataFrame:
    """Groups and links of every document, weighed by the counts of pairs in the whole corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's
    count is the highest of its first id), count_sum (counts added up over the
    links) and groups_sha256.  Each input row gives one row, also when it
    repeats another or its id is null; a repeated row is a document of its own
    in the counts.  Texts without tokens (see ``alignments``) give zeros and an
    empty digest; other columns are not looked at; an empty table gives no rows.
    """
    width = PieceVocabulary.of(pieces_path).processor.get_piece_size()
    found = stored(alignments(documents, bytes_path, pieces_path), "alignment-links")
    counts = stored(pair_counts(found, width), "alignment-pairs")
    first = stored(looked_up(found, frequent_pairs(counts, frequent)), "alignment-sums")
    rest = first.select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("at"))
    rest = rest.select("uid", F.col("at.pairs").alias("pair"), F.col("at.links").alias("links"))
    rest = rest.join(counts, "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"),
        F.sum(F.col("links") * F.col("n")).alias("_sum"),
    )
    added = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "_best"), ("count_sum", "_sum"))]
    head = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *added, "groups_sha256"]
    return first.drop("pairs", "links").join(rest, "uid", "left").select(*head)
