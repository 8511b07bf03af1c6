import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers import documents, sample
from tokenizers import Tokenizer
from tocsin.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_hold_every_id_once_and_sequences_have_no_gaps(spark):
    library = Tokenizer.from_file(PATH)
    texts = [row[1] for row in sample("documents")] + [None, "", "a", "a", "word " * 5000, "x" * 3000]
    rows = packing.packed(documents(spark, texts), PATH, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for n, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[n], key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == want
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.doc_tokens == len(want) for r in own)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 1024
    tokens = sum(r.length for r in rows)
    assert tokens / (1024 * len(sequences)) > 0.97


def test_repeated_rows_and_ids_are_all_packed(spark):
    frame = documents(spark, ["a b c", "a b c", None]).selectExpr("cast(null as long) AS doc_id", "text")
    rows = packing.packed(frame.unionByName(frame), PATH).collect()
    assert sorted(r.length for r in rows) == [1, 1, 4, 4, 4, 4]
    rows.sort(key=lambda r: r.offset)
    assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(6)]


def test_patterns_place_every_item(spark):
    demand = np.random.default_rng(1).integers(0, 500, 256)
    demand[:30] = 0
    found = packing.patterns(demand, 256)
    assert (sum(c * t for c, t in found) == demand).all()
    assert all((c * np.arange(1, 257)).sum() <= 256 for c, _ in found)
    least = max((demand * np.arange(1, 257)).sum() / 256, demand[128:].sum())
    assert sum(t for _, t in found) <= 1.01 * least


def test_knapsack_equals_brute_force():
    prices = np.array([0.0, 0.3, 0.5, 0.9, 0.2])
    worth, counts = packing.knapsack(prices, 11)
    best = max(
        a * 0.3 + b * 0.5 + c * 0.9 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 4 * c <= 11
    )
    assert abs(worth - best) < 1e-12 and (counts * np.arange(1, 6)).sum() <= 11


def test_the_pipeline_returns_the_ids_and_checksums_are_of_placed_ids(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["a b c", None, "word " * 3000]
    frame = documents(spark, texts)
    assert "pieces" in packing.tokenized(frame, PATH, 1024).columns
    rows = corpus_pipeline.sequences(spark, frame, "").collect()
    for n, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == n), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == library.encode(text or "", add_special_tokens=False).ids + [0]
    with_ids = {(r.doc_id, r.start): r.ids_crc32 for r in rows}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in packing.packed(frame, PATH).collect()} == with_ids
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_empty_table(spark):
    assert packing.packed(documents(spark, []), PATH, with_ids=True).collect() == []
    assert packing.packed(documents(spark, []), PATH).collect() == []
