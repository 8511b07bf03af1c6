import random
import re

import numpy as np
from helpers import documents, sample
from tocsin.llm import quality
from tocsin.llm.queries import op6_quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines, same = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            same += line in lines
            lines.append(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), same, len(hit)


def test_statistics_equal_plain_code():
    pick = random.Random(6)
    parts = ["a", "b", "é", "#", "|x", "\n", "\n", " ", "\t", "\x0b", "\x85", " ", "\n\n"]
    texts = [None, "", "a a a a a a", "x\ny\nx\n \nx"] + ["".join(pick.choice(parts) + " " * pick.randint(0, 1) for _ in range(60)) for _ in range(300)]
    for text in texts + [row[1][:1500] for row in sample("documents")[:40]]:
        assert quality.statistics(text and text.encode())[:5] == plain(text), repr(text)


def test_forest_isolates_what_is_rare():
    pick = np.random.default_rng(3)
    rows = np.vstack([pick.normal(0, 1, (990, 3)), pick.normal(9, 1, (10, 3))])
    scores = quality.Forest(rows).scores(rows)
    assert scores[990:].min() > np.quantile(scores[:990], 0.98) and scores.min() > 0 and scores.max() < 1
    assert (quality.Forest(np.ones((5, 3))).scores(np.ones((2, 3))) > 0).all()


def walked(tree, row):
    """The leaf that a row reaches, its depth, and the path length that the tree gives there, step by step."""
    feature, split, child, length = (c.tolist() for c in tree)
    at, depth = 0, 0
    while feature[at] >= 0:
        at, depth = child[at] + (1 if row[feature[at]] >= split[at] else 0), depth + 1
    return at, depth, length[at]


def unsuccessful(n):
    """Mean path length of an unsuccessful search among n rows, by the usual estimate of the harmonic number."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def test_scores_equal_path_lengths_walked_row_by_row():
    pick = np.random.default_rng(8)
    rows = np.round(pick.normal(0, 2, (150, 4)), 1)
    rows[100:110] = rows[0]
    forest = quality.Forest(rows, trees=12, size=150)
    lengths = np.zeros(len(rows))
    for tree in forest.trees:
        reached = [walked(tree, row) for row in rows]
        inside = {leaf: sum(r[0] == leaf for r in reached) for leaf, _, _ in reached}
        for leaf, depth, length in reached:
            # A tree of all rows: a leaf stands for the rows that reach it.
            assert depth <= forest.depth and abs(length - depth - unsuccessful(inside[leaf])) < 1e-12
        # Rows that are alone before the depth is used up are told apart; equal rows share a leaf.
        assert len({reached[n][0] for n in (0, *range(100, 110))}) == 1
        lengths += [length for *_, length in reached]
    want = 2 ** (-lengths / 12 / unsuccessful(150))
    assert np.allclose(forest.scores(rows), want, rtol=1e-12)


def test_good_rows_stay_and_bad_rows_go(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op6_quality(spark, folder).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    own = [(found[d], m) for d, m in marks.items() if not found[d].base_failed]
    good, bad = ([r.kept for r, m in own if m == wanted] for wanted in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert not any(r.kept and r.base_failed for r in found.values())


def test_base_rules(spark):
    texts = [" ".join(f"w{n}" for n in range(9)), " ".join(f"w{n}" for n in range(10)), "a b c d e " * 2 + " ".join(f"w{n}" for n in range(40))]
    texts.append("a b c d e " * 2 + " ".join(f"w{n}" for n in range(39)))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judged(documents(spark, texts), labels).collect()}
    assert {n: r.base_failed for n, r in found.items()} == {0: True, 1: False, 2: False, 3: True}


def test_without_labels_only_rules_reject(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    texts = [None, "", "one two", " ".join(f"w{n}" for n in range(20)), "same " * 50]
    found = {r.doc_id: r.kept for r in quality.judged(documents(spark, texts), labels).collect()}
    assert found == {0: False, 1: False, 2: False, 3: True, 4: False}
    assert quality.judged(documents(spark, []), labels).collect() == []
