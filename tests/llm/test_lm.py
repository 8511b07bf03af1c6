import math
from collections import Counter

import public_tokenizers
import pytest
from helpers import sample
from tocsin.llm import lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text, scores, other):
    """Probability of all ways to cut a text, one by one."""
    if not text:
        return 1.0
    total = math.exp(sum(other[b] for b in text[0].encode())) * segmentations(text[1:], scores, other)
    for size in range(1, len(text) + 1):
        if text[:size] in scores:
            total += math.exp(scores[text[:size]]) * segmentations(text[size:], scores, other)
    return total


def test_marginal_is_the_sum_over_all_segmentations():
    scores = {"▁": -1.0, "▁a": -2.0, "a": -1.5, "ab": -2.5, "b": -3.0, "▁ab": -4.0, "ba": -2.2}
    other = [-9.0] * 256
    lattice = lm.Lattice(scores, other, -1.0)
    for word in ("a", "ab", "abba", "xé", "", "aababa"):
        want = math.log10(segmentations("▁" + word, scores, other))
        assert lattice.word(word) == pytest.approx(want, abs=1e-9)


def test_words_of_one_length_at_a_time_equal_single_words():
    pieces = lm.vocabulary(PATH)
    scores = {pieces.id_to_piece(n): -3.0 - n % 97 / 10 for n in range(300, 32_000) if "▁" not in pieces.id_to_piece(n)[1:]}
    lattice = lm.Lattice(scores, [-7.0 - b % 5 for b in range(256)], -2.0)
    words = sorted({w for r in sample("documents")[:60] for w in lm.words_of((r[1] or "").encode())})
    words += ["", "a", "é", "日本", "\U0001f600x", "\x00", "x" * 48, "y" * 49, "z" * 3000]
    assert len(words) > 500
    assert lattice.words(words) == pytest.approx([lattice.word(w) for w in words], rel=1e-11)


def test_scores_equal_plain_code(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    texts = [r[1][:3000] for r in sample("documents")] + [None, "", "a a a", "a a a", "x" * 5000, "Ünï <s> \t \x85"]
    rows = [(n, t, None if n % 7 == 0 else n % 3 > 0, "z") for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, training boolean, word string")
    found = {r.doc_id: r for r in lm.scored(frame, PATH).collect()}
    counts = Counter()
    tokens = {n: [*((t or "").encode().lower().split()), b"\n"] for n, t, _, _ in rows}
    for n, _, training, _ in rows:
        counts.update(tokens[n] if training else ())
    total, distinct = sum(counts.values()), len(counts)
    for n, _, training, _ in rows:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[n])
        r = found[n]
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[n]), sum(counts[w] > 0 for w in tokens[n]), total)
        assert r.score < 0 and r.training == bool(training)
    assert found[len(texts) - 4].score == found[len(texts) - 3].score
    lexicon = lm.lexicon(lm.word_counts(frame.selectExpr("coalesce(training, false) training", "text")), lm.learnt(
        lm.word_counts(frame.selectExpr("coalesce(training, false) training", "text")), PATH))
    each = {r.word: r.lp for r in lexicon.collect()}
    for n in list(range(5)) + [len(texts) - 2]:
        assert found[n].score == pytest.approx(sum(each[w.decode()] for w in tokens[n]), rel=1e-9)


def test_without_training_rows(spark):
    frame = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, training boolean")
    row = lm.scored(frame, PATH).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0
    assert lm.scored(frame.where("false"), PATH).collect() == []
