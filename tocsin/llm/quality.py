"""Quality rules, and an isolation forest on their statistics.

The forest is grown on a bounded sample of labelled rows (``TREES`` samples of
``ROWS`` rows).  Every row is scored by its mean path length over the trees, and
the threshold comes from a histogram over all labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.shared import arrow_mapped, mapped, stored

SYMBOLS = b"#*$%&|<>"
LINE = 5
# Trees, rows of a tree, bins of the score histogram, and the share of good rows that may be lost.
TREES, ROWS, BINS, LOST = 100, 256, 1000, 0.01
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The statistics of a text in UTF-8."""
    text = text or b""
    words = text.split()
    lines, seen, same = text.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line.strip():
                same += line in seen
                seen.add(line)
    repeated = 0
    if len(words) > LINE:
        grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(LINE)))]
        if len(set(grams)) < len(grams):
            counts = Counter(grams)
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.array([k for k, g in enumerate(grams) if counts[g] > 1])
            np.add.at(cover, at, 1)
            np.add.at(cover, at + LINE, -1)
            repeated = int((np.cumsum(cover) > 0).sum())
    symbols, capitals, marks = (len(text) - len(text.translate(None, c)) for c in (SYMBOLS, CAPITALS, MARKS))
    return len(words), len(b"".join(words).decode()), symbols, same, repeated, capitals, marks


def rule_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text; a null text has no words."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))

    def make():
        return lambda doc, text: [(doc, *statistics(text))]

    return mapped(texts, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in STATISTICS), make)


def features(values: np.ndarray) -> np.ndarray:
    """Rates that do not grow with a text's length; ``values`` has the statistics as columns."""
    words = np.maximum(values[:, 0], 1)
    return np.column_stack(
        [
            np.log1p(values[:, 0]),
            values[:, 1] / words,
            np.log1p(100 * values[:, 2] / words),
            np.log1p(100 * values[:, 3] / words),
            values[:, 4] / words,
            values[:, 5] / np.maximum(values[:, 1], 1),
            values[:, 6] / np.maximum(values[:, 1], 1),
        ]
    )


def _expected(rows: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of so many rows."""
    return 0.0 if rows < 2 else 2 * (math.log(rows - 1) + 0.5772156649) - 2 * (rows - 1) / rows if rows > 2 else 1.0


class Forest:
    """Isolation trees as arrays of nodes: feature (-1 at a leaf), split, left child, path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = ROWS, seed: int = 1):
        pick = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.trees = [self._grown(rows[pick.choice(len(rows), self.size, False)], pick) for _ in range(trees)]

    def _grown(self, rows: np.ndarray, pick) -> tuple[np.ndarray, ...]:
        nodes, wait = [[-1, 0.0, 0, 0.0]], [(0, rows, 0)]
        while wait:
            at, part, depth = wait.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            able = np.flatnonzero(low < high)
            if depth == self.depth or not len(able):
                nodes[at] = [-1, 0.0, at, depth + _expected(len(part))]
                continue
            feature = int(pick.choice(able))
            split = pick.uniform(low[feature], high[feature])
            left = part[:, feature] < split
            if not left.any():
                split, left = high[feature], part[:, feature] < high[feature]
            nodes[at] = [feature, split, len(nodes), 0.0]
            wait += [(len(nodes), part[left], depth + 1), (len(nodes) + 1, part[~left], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        columns = list(zip(*nodes))
        return tuple(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, float)))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; short paths give high scores."""
        total, number = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                where = feature[at]
                at = np.where(where < 0, at, child[at] + (rows[number, where] >= split[at]))
            total += length[at]
        return 2 ** (-total / len(self.trees) / max(_expected(self.size), 1e-9))


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` rows, those with the smallest hash of their id."""
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    number = rows.count()
    near = rows.where(order < int(min(1.0, 2 * size / max(number, 1)) * (1 << 31)) + 1)
    found = near.orderBy(order, *STATISTICS).limit(size).select(*STATISTICS).toPandas()
    return found.to_numpy(float).reshape(-1, len(STATISTICS))


def scored(statistic: DataFrame, forest: Forest) -> DataFrame:
    """All columns of a table of statistics, and the anomaly score."""
    sent = statistic.sparkSession.sparkContext.broadcast(forest)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in statistic.schema)
    places = [statistic.columns.index(n) for n in STATISTICS]

    def run(batches):
        for batch in batches:
            values = np.column_stack([batch.column(p).to_numpy(zero_copy_only=False) for p in places]).astype(float)
            score = sent.value.scores(features(values)) if len(values) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return arrow_mapped(statistic, f"{kinds}, score double", run)


def threshold(labelled: DataFrame, lost: float = LOST) -> float:
    """The score that parts good from bad rows best while at most ``lost`` of the good rows reach it."""
    bins = labelled.groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), "quality").count().collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for row in bins:
        (good if row.quality else bad)[row.bin] += row["count"]
    if not good.sum() or not bad.sum():
        return math.inf
    above = [np.cumsum(x[::-1])[::-1] / x.sum() for x in (good, bad)]
    gain = np.where(above[0] <= lost, above[1] - above[0], -1)
    return float(gain.argmax() / BINS) if gain.max() > 0 else math.inf


def judged(documents: DataFrame, labels: DataFrame, lost: float = LOST) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept of every document.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in
    repeated 5-word windows.  ``kept``: not failed, and the anomaly score below
    the threshold.  Labels are rows (doc_id, quality); null qualities and ids
    are left out.  With no usable labels, or only good or bad ones, the forest
    rejects nothing.  Rows may repeat; other columns are not looked at.
    """
    rows = stored(rule_statistics(documents), "quality-statistics")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = rows.join(marks, "doc_id")
    sample = _sample(labelled, TREES * ROWS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if not len(sample):
        found, limit = rows.withColumn("score", F.lit(0.0)), math.inf
    else:
        found = stored(scored(rows, Forest(features(sample))), "quality-scores")
        limit = threshold(found.join(marks, "doc_id"), lost)
    kept = ~F.col("base_failed") & (F.col("anomaly") < limit)
    return (
        found.withColumnRenamed("score", "anomaly").withColumn("base_failed", failed).withColumn("kept", kept)
    )
