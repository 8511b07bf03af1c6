"""Language identification by a string kernel.

The kernel of two texts is the cosine of their sets of byte n-grams (one to
three bytes, presence only).  A bounded sample of labelled rows gives the
n-grams, the Nystroem landmarks and a kernel ridge regression of one language
against the rest.  Texts are scored in batches by two matrix products: with the
landmarks' n-gram sets, then with the regression's weights.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import extended, mapped, set_apart

# Labelled rows, n-grams and landmarks of a model at most, and the ridge.
ROWS, GRAMS, LANDMARKS, RIDGE = 2_000, 8_192, 128, 0.1
# Rows of a language that a model is fitted on at least, where there are as many.
LEAST = 10
CODES = 256 + (1 << 16) + (1 << 24)
UNKNOWN = "und"
# Bytes of a text that are looked at in one go, and how margins become shares.
PART, SHARPNESS = 1 << 20, 4.0


def codes(data: bytes) -> list[np.ndarray]:
    """Codes of all n-grams of a text in UTF-8 with A-Z lower-cased, a part of it at a time."""
    data, out = data.lower(), []
    for start in range(0, len(data), PART):
        part = np.frombuffer(data[start : start + PART + 2], np.uint8).astype(np.int32)
        two = (part[:-1] << 8) | part[1:]
        three = (two[:-1] << 8) | part[2:]
        out += [part, two + 256, three + 256 + (1 << 16)]
    return out


def lettered(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    name: str
    grams: np.ndarray
    landmarks: np.ndarray  # landmarks by n-grams, each of length one
    weights: np.ndarray  # landmarks by languages
    languages: list[str]

    def scores(self, sets: np.ndarray) -> np.ndarray:
        """Shares of the languages; ``sets`` are rows of n-gram presence."""
        size = np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1))
        margin = (sets @ self.landmarks.T / size) @ self.weights
        share = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        return share / share.sum(axis=1, keepdims=True)


_tables: dict[str, np.ndarray] = {}


def _table(model: Model) -> np.ndarray:
    """Place of each n-gram code plus one, kept by the worker process for one model."""
    if model.name not in _tables:
        _tables.clear()
        table = np.zeros(CODES, np.uint16)
        table[model.grams] = np.arange(1, len(model.grams) + 1)
        _tables[model.name] = table
    return _tables[model.name]


def presence(model: Model, texts: list[str | None]) -> np.ndarray:
    table, rows = _table(model), np.zeros((len(texts), len(model.grams) + 1), np.float32)
    for row, text in zip(rows, texts):
        for part in codes((text or "").encode()):
            row[table[part]] = 1
    return rows[:, 1:]


def _sampled(documents: DataFrame, languages: dict[str, int], size: int) -> DataFrame:
    """About ``size`` rows, as many of each language but ``LEAST`` where there are so many, by the hash of their id."""
    each = max(LEAST, size // len(languages))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    # A few more than wanted, so that hardly any language is short of rows.
    limits = [(n, int(min(1.0, (1.5 * each + LEAST) / number) * (1 << 31)) + 1) for n, number in languages.items()]
    limits = documents.sparkSession.createDataFrame(limits, "lang string, _limit long")
    kind = documents.schema["lang"].dataType
    near = documents.join(F.broadcast(limits.withColumn("lang", F.col("lang").cast(kind))), "lang").where(order < F.col("_limit"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= each)


def fitted(documents: DataFrame, rows: int = ROWS, landmarks: int = LANDMARKS, grams: int = GRAMS) -> Model | None:
    """A model from rows (doc_id, text, lang); None if no row has a language and a letter.

    Every language is learnt that has a row with an id and a letter.  The sample
    is of at most ``rows`` rows, or of ``LEAST`` a language where that is more;
    only their n-gram codes reach the driver.
    """
    usable = documents.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    usable = usable.where(F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    picked = _sampled(usable, {r["lang"]: r["count"] for r in counts}, rows).select("lang", "doc_id", "text")

    def make():
        def step(lang, doc, text):
            if not lettered(text):
                return []
            found = np.unique(np.concatenate([np.unique(p) for p in codes(text.encode())]))
            return [(lang, str(doc), found.astype("<i4").tobytes())]

        return step

    found = sorted(mapped(picked, "lang string, doc string, codes binary", make).collect(), key=lambda r: (r[0], r[1]))
    if not found:
        return None
    sets = [np.frombuffer(r[2], "<i4") for r in found]
    names = [r[0] for r in found]
    languages = sorted(set(names))
    code, number = np.unique(np.concatenate(sets), return_counts=True)
    kept = np.sort(code[np.lexsort((code, -number))[:grams]])
    rows_by = np.zeros((len(sets), len(kept)), np.float32)
    for row, own in zip(rows_by, sets):
        row[np.searchsorted(kept, own[np.isin(own, kept)])] = 1
    unit = rows_by / np.sqrt(np.maximum(rows_by.sum(axis=1, keepdims=True), 1))
    pick = np.random.default_rng(1)
    each = max(1, landmarks // len(languages))
    own = np.array(names)
    chosen = np.concatenate(
        [pick.permutation(np.flatnonzero(own == lang))[:each] for lang in languages]
    )
    marks = unit[chosen]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    mapped_rows = (unit @ marks.T).astype(float) @ root
    wanted = np.where(own[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([1.0 / max((own == lang).sum(), 1) for lang in own]) * len(own) / len(languages)
    normal = (mapped_rows * share[:, None]).T @ mapped_rows + RIDGE * np.eye(good.sum())
    weights = root @ np.linalg.solve(normal, (mapped_rows * share[:, None]).T @ wanted)
    return Model(uuid.uuid4().hex, kept, marks, weights.astype(np.float32), languages)


def identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``documents``, lang_pred and score; columns of these names are replaced.

    Every whole text is scored.  A null text, or one without a letter, is
    ``und`` with score 0, and so is every text where nothing could be learnt.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def step(texts):
            if model is None:
                return [(UNKNOWN, 0.0) for _ in texts]
            share = model.scores(presence(model, texts))
            best = share.argmax(axis=1)
            return [
                (model.languages[b], float(share[n, b])) if lettered(t) else (UNKNOWN, 0.0)
                for n, (t, b) in enumerate(zip(texts, best))
            ]

        return step

    return extended(documents, "lang_pred string, score double", make)


def remainder(documents: DataFrame, by: int):
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def accepted(documents: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """The documents in a learnt language with at least the score ``least``; columns stay as they are."""
    apart, restored = set_apart(documents)
    found = identified(apart, model)
    return restored(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))
