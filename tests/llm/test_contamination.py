import random
import re

from helpers import SCHEMA, documents
from tocsin.llm import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    own, hit, names = words(text), set(), set()
    for item, other in items:
        ref = words(other)
        size = min(13, len(ref))
        for k in range(len(ref) - size + 1) if ref else ():
            for at in range(len(own) - size + 1):
                if own[at : at + size] == ref[k : k + size]:
                    hit |= set(range(at, at + size))
                    names.add(str(item))
    return len(own), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(own)


def test_hits_equal_brute_force_in_one_and_in_many_shards(spark):
    pick = random.Random(2)
    vocabulary = ["a", "B", "c1", "é", "9", "Zz", "\x85"]
    make = lambda n: pick.choice([" ", "-", "_ "]).join(pick.choice(vocabulary) for _ in range(n))
    items = [(n, make(pick.choice([0, 1, 3, 13, 14, 30]))) for n in range(20)] + [(20, None), (3, "x y")]
    items = [(n, t) for n, t in items if t is None or len(words(t)) != 1]
    texts = [make(pick.randint(0, 60)) for _ in range(60)] + [None, "", " . "]
    texts += [f"{make(5)} {t} {make(5)}" for _, t in items if t]
    benchmark = spark.createDataFrame([(n, t, "x") for n, t in items], "item_id long, text string, n_hit string")
    for limit in (contamination.SHARD, 60):
        found = contamination.scan(documents(spark, texts), benchmark, limit=limit)
        assert found.columns == [f.split()[0] for f in SCHEMA.split(", ") if "n_words" not in f] + [
            "n_words", "n_hit", "hit_spans", "hit_items", "contaminated"
        ]
        for r in found.collect():
            assert (r.n_words, r.n_hit, r.hit_items, r.contaminated) == plain(texts[r.doc_id], items), texts[r.doc_id]


def test_spans_or_documents_are_removed(spark):
    item = " ".join(f"w{n}" for n in range(13))
    texts = [f"Before, {item}! after", "clean text", None]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    frame = documents(spark, texts)
    kept = contamination.decontaminate(frame, benchmark)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    cut = contamination.decontaminate(frame, benchmark, "spans")
    assert cut.columns == frame.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {0: "Before, ! after", 1: "clean text", 2: None}


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert contamination.scan(documents(spark, []), benchmark).collect() == []
    assert contamination.scan(documents(spark, ["a"]), benchmark).first().n_hit == 0


def test_a_shard_is_a_few_bytes_for_each_byte_of_text():
    pick = random.Random(6)
    vocabulary = [f"w{n}" for n in range(5000)]
    items = [(n, " ".join(pick.choice(vocabulary) for _ in range(200)).encode()) for n in range(1000)]
    windows = contamination.Windows(items, 13)
    assert windows.held() < 8 * sum(len(t) for _, t in items)
    import pickle

    assert len(pickle.dumps(windows)) < 8 * sum(len(t) for _, t in items)
    spans, owners = windows.find(contamination.words_of(b"x " + items[7][1] + b" y " + items[9][1][: 40]))
    assert spans == [(1, 200)] and owners == {7}


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    whole = contamination.Sized.hashes_of

    def poor(self, ids, starts):
        return whole(self, ids, starts) % contamination.np.uint64(3 if self.seed < 2 else 2**63)

    monkeypatch.setattr(contamination.Sized, "hashes_of", poor)
    items = [(n, " ".join(f"a{n}b{k}" for k in range(15)).encode()) for n in range(9)]
    windows = contamination.Windows(items, 13)
    assert windows.sized[0].seed == 2
    for n, text in items:
        assert windows.find(contamination.words_of(text)) == ([(0, 15)], {n})


def test_shards_follow_one_another(spark):
    """With several shards no stage holds more than one, and a very long text is searched whole."""
    items = [(n, " ".join(f"i{n}w{k}" for k in range(20))) for n in range(30)]
    texts = ["clean " * 50, " ".join(t for _, t in items), None, "z " * 100_000 + items[3][1], items[5][1], items[5][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.scan(documents(spark, texts), benchmark, limit=400)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = {r.doc_id: r for r in found.collect()}
    for n, text in enumerate(texts):
        if n != 3:
            assert (rows[n].n_words, rows[n].n_hit, rows[n].hit_items, rows[n].contaminated) == plain(text, items)
    assert (rows[1].n_hit, len(rows[1].hit_items), rows[1].hit_spans[0].length) == (600, 30, 600)
    assert (rows[3].n_words, rows[3].n_hit, rows[3].hit_items, rows[3].contaminated) == (100_020, 20, ["3"], False)
