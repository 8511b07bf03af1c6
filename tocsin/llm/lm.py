"""Document likelihood under a lattice of subwords.

The pieces are those of an existing vocabulary; their scores are learnt from
the training documents.  A word's probability is the sum over all ways to cut
it into pieces, by a forward recursion in log space.  Pieces never span blanks,
so a document's lattice is a chain of its words' lattices, and its log
probability is the sum of theirs.

The lexicon (every distinct word with its training count and log probability)
grows with the corpus and is never broadcast whole.  Its ``FREQUENT`` most
frequent short words, a table of fixed size, are looked up inside the tasks;
only a document's other words are shuffled, once per document and word.
"""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.shared import SLICE, arrow_mapped, least_power, mapped, stored

# Words of the broadcast tier and their longest; words a task counts before it sends them on.
FREQUENT, LONGEST, COUNTED = 65_536, 48, 150_000
# A blank in the vocabulary's spelling, and how byte pieces are written.
BLANK, BYTE = "▁", "<0x{:02X}>"
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # of substring hashes
END = "\n"  # stands for a document's end among words, which have no line ends

_loaded: dict[str, object] = {}


def vocabulary(path: str):
    """The sentencepiece model, read once per worker process."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    return _loaded[path]


def words_of(text: bytes | None) -> list[str]:
    """Words of a text, A to Z in lower case."""
    return [w.decode() for w in (text or b"").lower().split()]


class Lattice:
    """Marginal log10 probability of words under piece log probabilities (base e)."""

    def __init__(self, scores: dict[str, float], other: list[float], end: float):
        self.scores, self.other, self.end = scores, other, end
        self.longest = max(map(len, scores), default=1)

    def word(self, word: str) -> float:
        """Sum over all segmentations of the word with its blank; characters may also be spelt in bytes."""
        text = BLANK + word
        scores, other, longest = self.scores.get, self.other, self.longest
        forward = [0.0]
        for stop in range(1, len(text) + 1):
            start = stop - 1
            spelt = sum(other[b] for b in text[start].encode())
            terms = [forward[start] + spelt]
            for start in range(max(0, stop - longest), stop):
                if (score := scores(text[start:stop])) is not None:
                    terms.append(forward[start] + score)
            top = max(terms)
            forward.append(top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top)
        return forward[-1] / math.log(10)

    def _tables(self) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.uint64]:
        """For each length of a piece, the sorted hashes of its pieces and their scores; no two pieces share a hash."""
        if self._made is None:
            by_length: dict[int, list[str]] = {}
            for piece in self.scores:
                by_length.setdefault(len(piece), []).append(piece)
            factor = FACTOR
            while self._made is None:
                tables = {}
                for size, pieces in by_length.items():
                    grid, hashes = codes(pieces), np.zeros(len(pieces), np.uint64)
                    for k in range(size):
                        hashes = (hashes + grid[:, k]) * factor
                    order = np.argsort(hashes)
                    tables[size] = hashes[order], np.array([self.scores[pieces[n]] for n in order])
                if all((np.diff(h) != 0).all() for h, _ in tables.values()):
                    self._made = tables, factor
                factor += np.uint64(2)
        return self._made

    _made = None

    def equally_long(self, words: list[str]) -> np.ndarray:
        """``word`` of words of one length: the recursion runs over all of them at a time.

        Pieces are looked up by 64-bit hashes of all substrings.
        """
        tables, factor = self._tables()
        grid = codes([BLANK + w for w in words])
        size = grid.shape[1]
        known, place = np.unique(grid, return_inverse=True)
        spelt = np.array([sum(self.other[b] for b in chr(int(c) - 1).encode()) for c in known])[place].reshape(grid.shape)
        found, hashes = [], np.zeros((len(words), size), np.uint64)
        for length in range(1, min(self.longest, size) + 1):
            hashes = (hashes[:, : size - length + 1] + grid[:, length - 1 :]) * factor
            if length in tables:
                table, scores = tables[length]
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                here = table[at] == hashes
                if here.any():
                    found.append((length, np.where(here, scores[at], -np.inf)))
        forward = np.zeros((len(words), size + 1))
        for stop in range(1, size + 1):
            terms = [forward[:, stop - 1] + spelt[:, stop - 1]]
            terms += [forward[:, stop - n] + scores[:, stop - n] for n, scores in found if n <= stop]
            forward[:, stop] = np.logaddexp.reduce(np.array(terms), axis=0)
        return forward[:, size] / math.log(10)

    def words(self, words: list[str]) -> list[float]:
        """``word`` of each of some words; long ones go one by one."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            by_length.setdefault(min(len(word), LONGEST + 1), []).append(n)
        for size, own in by_length.items():
            some = [words[n] for n in own]
            out[own] = self.equally_long(some) if size <= LONGEST else [self.word(w) for w in some]
        return out.tolist()


def codes(texts: list[str]) -> np.ndarray:
    """Code points, from 1, of texts of one length."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    return points.reshape(len(texts), -1)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, c (in rows with ``training``) and n (in all rows); the end of a document is a word.

    Tasks add up words in bounded tables before any shuffle.
    """
    rows = documents.select("training", F.col("text").cast("binary").alias("text"))

    def run(batches):
        known: tuple[Counter, Counter] = (Counter(), Counter())

        def flushed():
            words = list(known[0].keys() | known[1].keys())
            c = [known[1][w] for w in words]
            n = [known[0][w] + k for w, k in zip(words, c)]
            for counts in known:
                counts.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"]
            )

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for training, text in zip(*(c.to_pylist() for c in part.columns)):
                    known[training].update(words_of(text))
                    known[training][END] += 1
                    if len(known[0]) + len(known[1]) > COUNTED:
                        yield from flushed()
        yield from flushed()

    found = arrow_mapped(rows, "word string, c long, n long", run)
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learnt(counts: DataFrame, path: str) -> Lattice:
    """Piece scores from the training counts: the vocabulary's own cut of every word, add-one smoothed.

    The driver gets one number for each piece of the vocabulary.
    """

    def run(batches):
        pieces: Counter = Counter()
        model = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                words, numbers = (c.to_pylist() for c in batch.slice(start, 4096).columns)
                for ids, number in zip(model.encode(words, num_threads=1), numbers):
                    for piece in ids:
                        pieces[piece] += number
        columns = [pa.array(list(pieces.keys()), pa.int32()), pa.array(list(pieces.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "n"])

    model = vocabulary(path)
    trained = counts.where(F.col("c") > 0)
    words = trained.where(F.col("word") != END).select("word", "c")
    found = arrow_mapped(words, "piece int, n long", run).groupBy("piece").agg(F.sum("n").alias("n")).collect()
    ends = trained.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    number = {r.piece: r.n for r in found}
    usable, spelt = {}, {}
    for piece in range(model.get_piece_size()):
        name = model.id_to_piece(piece)
        if model.is_byte(piece):
            spelt[name] = piece
        elif not (model.is_control(piece) or model.is_unknown(piece)) and BLANK not in name[1:]:
            usable[name] = piece
    total = sum(number.get(p, 0) + 1 for p in [*usable.values(), *spelt.values()]) + ends + 1
    score = lambda n: math.log((n + 1) / total)
    other = [score(number.get(spelt.get(BYTE.format(b)), 0)) for b in range(256)]
    return Lattice({name: score(number.get(p, 0)) for name, p in usable.items()}, other, score(ends))


def lexicon(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """word, c, n and lp, the word's marginal log10 probability."""
    sent = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        lattice = sent.value
        end = lattice.end / math.log(10)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                words = part.column(0).to_pylist()
                lp = [end if w == END else p for w, p in zip(words, lattice.words(words))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lp, pa.float64())], ["word", "c", "n", "lp"])

    return arrow_mapped(counts.select("word", "c", "n"), "word string, c long, n long, lp double", run)


def scored(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``documents`` has doc_id, text and training (boolean, null is false); the
    model learns from rows with ``training``.  Tokens are words and one end per
    document; a null text is the end alone.  ``base_score`` is the add-one
    unigram log10 probability, ``score`` that of the lattice.  Rows may repeat;
    each gives one row.  With no training rows all counts are zero and pieces
    are equally likely.  Other columns are not looked at.
    """
    spark = documents.sparkSession
    training = F.coalesce(F.col("training"), F.lit(False)).alias("training")
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", training, "text")
    counts = stored(word_counts(rows), "lm-counts")
    tokens, distinct = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, smooth = tokens or 0, (tokens or 0) + distinct + 1
    words = stored(lexicon(counts, learnt(counts, path)), "lm-lexicon")
    known = F.col("c") > 0
    named = words.select(
        "word", known.cast("long").alias("known"), F.log10((F.col("c") + 1) / F.lit(float(smooth))).alias("base"), "lp", "n"
    )
    short = named.where((F.octet_length("word") <= LONGEST) | (F.col("word") == END))
    often = F.col("n") >= 2.0 ** least_power(short, "n", FREQUENT)
    top = short.where(often | (F.col("word") == END))
    tier = spark.sparkContext.broadcast({r.word: (r.known, r.base, r.lp) for r in top.collect()})
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        frequent = tier.value

        def step(uid, doc, training, text):
            own = Counter(words_of(text))
            own[END] += 1
            out, n, k, base, lp = [], 0, 0, 0.0, 0.0
            for word, number in own.items():
                n += number
                if found := frequent.get(word):
                    k += number * found[0]
                    base += number * found[1]
                    lp += number * found[2]
                else:
                    out.append((uid, None, None, word, number, None, None, None))
            # A blank never stands in a word, so this row meets no word of the lexicon.
            out.append((uid, doc, training, f" {uid}", n, k, base, lp))
            return out

        return step

    fields = f"uid long, doc_id {kind}, training boolean, word string, number long, k long, base0 double, lp0 double"
    parts = mapped(rows.select("uid", "doc_id", "training", F.col("text").cast("binary").alias("text")), fields, make)
    met = parts.join(named.select("word", "known", "base", "lp"), "word", "left")
    own = F.col("k").isNotNull()
    sums = met.groupBy("uid").agg(
        F.first(F.when(own, F.struct("doc_id", "training", "number")), True).alias("row"),
        F.sum(F.when(own, F.col("k")).otherwise(F.col("number") * F.col("known"))).alias("n_known"),
        F.sum(F.when(own, F.col("base0")).otherwise(F.col("number") * F.col("base"))).alias("base_score"),
        F.sum(F.when(own, F.col("lp0")).otherwise(F.col("number") * F.col("lp"))).alias("score"),
    )
    return sums.select(
        "row.doc_id",
        "row.training",
        F.col("row.number").alias("n_tokens"),
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
