import random
from collections import Counter

import pytest
from helpers import documents
from tocsin.llm import substrings


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for own in words:
        gone = set()
        for k in range(len(own) - window + 1):
            if seen[tuple(own[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((len(own), b" ".join(w for k, w in enumerate(own) if k not in gone).decode()))
    return out


def corpus(pick):
    """Copies, edited copies, passages in changing surroundings, and words that repeat on and on."""
    make = lambda n: [f"{pick.choice('abcdefgh')}{pick.randint(0, 40)}" for _ in range(n)]
    base, passage = make(150), make(50)
    texts = [" ".join(base)] * 3
    for _ in range(30):
        own = list(base)
        own[pick.randrange(150)] = "edit"
        texts.append(" ".join(own))
    texts += [" ".join(make(pick.randint(0, 60)) + passage + make(pick.randint(0, 60))) for _ in range(30)]
    texts += [" ".join(make(pick.randint(0, 200))) for _ in range(20)]
    return texts + ["la " * 200, "x y " * 40, "la " * 35, "z " * 36, None, "", " \n", "é\x85 ü\t" * 30]


@pytest.mark.parametrize("limit", [1, 64])
def test_kept_words_equal_brute_force(spark, limit):
    texts = corpus(random.Random(11))
    found = {r.doc_id: r for r in substrings.deduplicated(documents(spark, texts), limit=limit).collect()}
    for n, (size, kept) in enumerate(plain(texts, substrings.WINDOW)):
        r = found[n]
        assert (r.n_words, r.kept_text, r.text) == (size, kept, texts[n]), n
        assert sum(s["length"] for s in r.removed_spans) == size - len(kept.split(" ") if kept else [])


def test_a_hot_anchor_is_not_one_task(spark):
    """Thousands of different segments around one common passage end in many partitions."""
    pick = random.Random(5)
    common = [f"c{n}" for n in range(40)]
    texts = [" ".join([f"a{pick.random()}" for _ in range(5)] + common + [f"b{pick.random()}"]) for _ in range(3000)]
    frame = documents(spark, texts)
    found = substrings.deduplicated(frame)
    assert {r.kept_text for r in found.collect()} == {" ".join(t.split()[:5] + t.split()[45:]) for t in texts}
    marks = substrings.all_segments(frame, substrings.WINDOW)
    largest = marks.groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert largest >= 3000
    segments = marks.select("anchor", "seg").distinct()
    dealt = segments.selectExpr("pmod(hash(xxhash64(anchor, seg)), 16) AS p").groupBy("p").count().collect()
    assert max(r["count"] for r in dealt) < 2 * segments.count() / 16


def test_rows_that_share_ids_and_parts_of_long_texts(spark, monkeypatch):
    text = " ".join(f"w{n}" for n in range(60))
    frame = documents(spark, [text, text, "other " + text[:300]])
    frame = frame.selectExpr("if(doc_id < 2, null, doc_id) AS doc_id", "text", "fp AS seg")
    rows = sorted(substrings.deduplicated(frame).collect(), key=lambda r: r.doc_id or 0)
    assert [r.kept_text for r in rows][:2] == ["", ""] and rows[2].kept_text.startswith("other")
    monkeypatch.setattr(substrings, "PART", 16)
    cut = substrings.segments([text.encode()], 35)
    assert sum(s[2].sum() for s in cut) == 26 and len(cut) == 2


def test_segments_do_not_depend_on_neighbours():
    texts = [t and t.encode() for t in corpus(random.Random(13))]
    alone = [[] for _ in texts]
    for n, text in enumerate(texts):
        for s in substrings.segments([text]):
            alone[n] += zip(*(c.tolist() for c in s[1:]))
    together = [[] for _ in texts]
    for s in substrings.segments(texts):
        for n, *rest in zip(*(c.tolist() for c in s)):
            together[n].append(tuple(rest))
    assert alone == together and sum(map(len, alone)) > 100


def test_automaton_counts_occurrences():
    pick = random.Random(12)
    for _ in range(50):
        rows = [([pick.choice("ab") for _ in range(pick.randint(0, 14))], pick.randint(1, 2)) for _ in range(4)]
        shard = substrings.Automaton()
        for words, times in rows:
            shard.add(words, times)
        shard.settle()
        seen = Counter()
        for words, times in rows:
            for k in range(len(words) - 3):
                seen[tuple(words[k : k + 4])] += times
        for words, _ in rows:
            assert shard.repeated(words, 4) == [k for k in range(len(words) - 3) if seen[tuple(words[k : k + 4])] > 1]


def test_empty_table(spark):
    assert substrings.deduplicated(documents(spark, [])).collect() == []
