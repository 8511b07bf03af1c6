"""Token counts of whole texts by a byte-level vocabulary of the tokenizers library.

A text is cut where the vocabulary's pre-tokenizer always cuts: before a single
blank that a visible character follows, and at a single line end.  Nothing the
merges do crosses such a cut, so a text's tokens are its chunks' tokens, and
chunks repeat.  Each worker looks chunks up in two tiers: the frequent ones come
in a broadcast table of fixed size, the others are encoded once and kept in the
worker's own table, which is emptied when it is full.  No chunk is shuffled.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.shared import SLICE, arrow_mapped, least_power, mapped, stored

# The string that the vocabulary turns into its special token wherever it stands.
SPECIAL = "<|endoftext|>"
# White space that makes the quick cut unsafe: all but single inner blanks and line ends.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n ", "\n\n"]
# Marks a chunk that is spelt out; no other chunk begins like this.
WHOLE = "\n\n"
BEFORE_WORD = re.compile(r"(?= [^\s\x1c-\x1f])")
# Chunks in the frequent tier, chunks each task proposes for it, and the longest such chunk.
FREQUENT, PROPOSED, LONGEST = 32_768, 1_024, 64
# Characters of the chunks that a worker keeps, with 100 for each chunk's place; a chunk that is longer than SHORT
# (text without blanks) is encoded each time.  Chunks that are counted at one time while looking for frequent ones.
KEPT, SHORT, COUNTED = 100_000_000, 256, 200_000
# Marks that the pre-tokenizer always cuts off the letters before them; an apostrophe may begin a contraction.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The vocabulary, read once per worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def chunks(text: str) -> list[str]:
    """Chunks of a text without special strings; a chunk stands for itself with its blank cut off.

    All but the first chunk, and those that begin with a line end, had a blank
    in front.  Chunks behind the mark WHOLE are spelt out.
    """
    if not text:
        return []
    if text[0] in " \n" or text[-1] in " \n" or any(odd in text for odd in ODD):
        return [WHOLE + c for c in BEFORE_WORD.split(text) if c]
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = WHOLE + parts[0]
    return parts


def spelt(chunk: str) -> str:
    """The characters that a chunk stands for."""
    if chunk.startswith(WHOLE):
        return chunk[len(WHOLE) :]
    return chunk if chunk[:1] == "\n" else " " + chunk


class Encoder:
    """Values of chunks (lengths or ids), kept per worker process in bounded memory.

    Values of neighbouring chunks must add up.  A new word with marks behind it
    is looked up as the word and the marks.
    """

    kept: dict[tuple, Encoder] = {}

    def __init__(self, path: str, value: Callable, frequent: dict | None = None):
        self.path, self.value, self.frequent = path, value, frequent or {}
        self.known, self.size = dict(self.frequent), 0

    @classmethod
    def of(cls, path: str, name: str, value: Callable, frequent=None) -> Encoder:
        """One encoder per process for a vocabulary and a named kind of value; ``frequent`` is broadcast."""
        key = (path, name)
        if key not in cls.kept:
            cls.kept.clear()
            cls.kept[key] = cls(path, value, frequent and frequent.value)
        return cls.kept[key]

    def values(self, text: str) -> list:
        """Values of a text's chunks in order, special strings included."""
        out: list = []
        for n, part in enumerate(text.split(SPECIAL)):
            if n:
                out.append(self._of([WHOLE + SPECIAL])[0])
            out.extend(self._of(chunks(part)))
        return out

    def _of(self, keys: list[str]) -> list:
        found = list(map(self.known.get, keys))
        if None in found:
            if self.size > KEPT:
                self.known, self.size = dict(self.frequent), 0
            long = self._learnt({k for k in keys if k not in self.known})
            found = [long[k] if k in long else self.known[k] for k in keys]
        return found

    def _learnt(self, wanted: set[str]) -> dict:
        """Keep the values of some chunks; returns those of chunks that are too long to be kept."""
        known, ends, missing, long = self.known, {}, set(), []
        for key in wanted:
            word = key.rstrip(MARKS)
            if len(key) > SHORT:
                long.append(key)
            elif word != key and word.isalpha():
                ends[key] = (word, WHOLE + key[len(word) :])
                missing.update(ends[key])
            else:
                missing.add(key)
        new = [k for k in missing if k not in known] + long
        encoded = tokenizer(self.path).encode_batch_fast([spelt(k) for k in new], add_special_tokens=False)
        values = dict(zip(new, map(self.value, encoded)))
        told = {k: values.pop(k) for k in long}
        known.update(values)
        known.update((k, known[word] + known[marks]) for k, (word, marks) in ends.items())
        self.size += sum(len(k) + 100 for k in (*values, *ends))
        return told


def frequent_chunks(documents: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the chunks that occur most often, at most ``size`` of them.

    Every task counts the chunks of all its texts, dropping the rarest when its
    table is full, and proposes its most frequent ones; only these proposals
    are added up.  The table decides speed, never results.
    """

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(start, SLICE).to_pylist():
                    counts.update(c for c in chunks(text) if len(c) <= LONGEST)
                    if len(counts) > COUNTED:
                        for chunk, _ in counts.most_common()[COUNTED // 4 :]:
                            del counts[chunk]
        found = counts.most_common(PROPOSED)
        columns = [pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "n"])

    texts = documents.where(F.col("text").isNotNull()).select("text")
    found = arrow_mapped(texts, "chunk string, n long", run).groupBy("chunk").agg(F.sum("n").alias("n"))
    found = stored(found, "tokens-chunks")
    names = [r.chunk for r in found.where(F.col("n") >= 2.0 ** least_power(found, "n", size)).collect()]
    encoded = tokenizer(path).encode_batch([spelt(c) for c in names], add_special_tokens=False)
    return {c: len(e) for c, e in zip(names, encoded)}


def token_counts(documents: DataFrame, path: str, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of ``Tokenizer.encode(text, add_special_tokens=False)``,
    with the special string inside a text taken as the special token.  A null
    text counts as empty: 0 bytes, 0 tokens.  Ids may be null or repeated; each
    input row gives one output row.  Other columns are not looked at.
    """
    table = documents.sparkSession.sparkContext.broadcast(frequent_chunks(documents, path, frequent))

    name = f"lengths of {uuid.uuid4().hex}"

    def make():
        encoder = Encoder.of(path, name, len, table)
        return lambda doc, size, text: [(doc, size, sum(encoder.values(text)))]

    rows = documents.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = mapped(rows, f"doc_id {kind}, n_bytes long, n_tokens long", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
