import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from helpers import documents, sample
from tocsin.llm import alignment
from tocsin.llm.queries import op12_token_alignment
from tocsin.llm.vocabularies import ByteVocabulary
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NONE = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0, "groups_sha256": ""}
ODD = [
    None,
    "",
    " ",
    "a",
    "a▁b",
    "the <|endoftext|> of <s> a </s> text <0x41>",
    "\x00 nul\tand\r\n\n lines  two   blanks ",
    "naïve Straße 東京 🙂🙂 é",
    "x" * 3000,
    "東京" * 500,
    "  　\x85\x1c",
]


def shown_bytes() -> dict[str, int]:
    """Bytes of a byte-level entry's characters, from the library's own pre-tokenizer."""
    from tokenizers.pre_tokenizers import ByteLevel

    found = {}
    for n in (*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000)):
        text = "".join(piece for piece, _ in ByteLevel(add_prefix_space=False).pre_tokenize_str(chr(n)))
        found.update(zip(text, chr(n).encode()))
    return found


def brute(texts) -> list[dict]:
    """The result in plain code: all pairs of tokens of a document are looked at."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    shown = shown_bytes()
    found, counts = [], Counter()
    for text in texts:
        row = {"links": [], "groups": [], "a": [], "b": []}
        if text:
            raw, ids = (" " + text).encode(), first.encode(" " + text, add_special_tokens=False)
            a = [(n, bytes(shown[c] for c in first.id_to_token(n))) for n in ids.ids]
            b = []
            for n in second.encode(text):
                piece = second.id_to_piece(n)
                b.append((n, bytes([int(piece[3:5], 16)]) if second.is_byte(n) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                spans = []
                for side in (a, b):
                    at, own = 0, []
                    for n, x in side:
                        own.append((n, at, at + len(x)))
                        at += len(x)
                    spans.append(own)
                row["a"], row["b"] = spans
                row["links"] = [(n, m) for n, s, e in spans[0] for m, t, f in spans[1] if s < f and t < e]
                cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
                for start, end in zip([0, *cuts], cuts):
                    sides = (",".join(str(n) for n, s, e in own if start <= s and e <= end) for own in spans)
                    row["groups"].append("|".join(sides))
        counts.update(set(row["links"]))
        found.append(row)
    highest = defaultdict(int)
    for (n, _), times in counts.items():
        highest[n] = max(highest[n], times)
    return [
        {
            "n_a": len(r["a"]),
            "n_b": len(r["b"]),
            "n_groups": len(r["groups"]),
            "n_links": len(r["links"]),
            "n_best": sum(counts[x] == highest[x[0]] for x in r["links"]),
            "count_sum": sum(counts[x] for x in r["links"]),
            "groups_sha256": hashlib.sha256(";".join(r["groups"]).encode()).hexdigest() if r["groups"] else "",
        }
        for r in found
    ]


def rows_of(frame) -> dict:
    return {r.doc_id: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in frame.collect()}


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 50, 0])
def test_equal_to_brute_force_in_both_tiers(spark, frequent):
    texts = ODD + [row[1][:600] for row in sample("documents")[:40] if row[1]] + ["a", "a b", "the the"]
    found = rows_of(alignment.token_alignment(documents(spark, texts), A, B, frequent))
    assert found == dict(enumerate(brute(texts)))
    assert found[0] == found[1] == found[4] == NONE


def test_the_query_agrees_with_brute_force(spark, tmp_path):
    rows = [r for r in sample("documents") if len(r[1] or "") < 3000][:100]
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_of(op12_token_alignment(spark, str(tmp_path)))
    assert found == {r[0]: x for r, x in zip(rows, brute([r[1] for r in rows]))}


def test_sections_do_not_change_the_result():
    texts = [row[1] for row in sample("documents") if row[1]] + [t for t in ODD if t]
    one, many = alignment.Aligner(A, B), alignment.Aligner(A, B)
    assert [" ".join(alignment.sections(t, 7)) for t in texts] == texts
    whole = [one.document(t) for t in texts]
    size, alignment.sections.__defaults__ = alignment.sections.__defaults__, (7,)
    try:
        parts = [many.document(t) for t in texts]
    finally:
        alignment.sections.__defaults__ = size
    for w, p in zip(whole, parts):
        assert (w is None) == (p is None)
        assert w is None or (w[:5] == p[:5] and [x.tolist() for x in w[5:]] == [x.tolist() for x in p[5:]])


def test_stretches_equal_a_plain_scan():
    rng = random.Random(3)
    for _ in range(500):
        a = sorted(rng.sample(range(60), rng.randint(1, 40)))
        b = list(a) if rng.random() < 0.5 else sorted(rng.sample(range(60), rng.randint(1, 40)))
        if rng.random() < 0.5 and len(b) > 2:
            del b[rng.randrange(len(b))]
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert alignment.stretch(a, b, i, j) == want


def test_links_are_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 5)
    links = alignment.Links()
    for codes in ([1, 1, 2], [2, 3], [1, 9, 9, 9, 9, 9, 9], [4]):
        links.add(alignment.np.array(codes))
    found = dict(zip(*(x.tolist() for x in links.total())))
    assert found == {1: 3, 2: 2, 3: 1, 4: 1, 9: 6}


def test_byte_ids_are_those_of_the_library():
    library, own = Tokenizer.from_file(A), ByteVocabulary.of(A)
    texts = [row[1] or "" for row in sample("documents")] + [t or "" for t in ODD]
    texts += ["".join(chr(c) + "a1 " for c in range(n, n + 256) if not 0xD800 <= c < 0xE000) for n in range(0, 0x30000, 256)]
    texts += ["a <|endoftext|><|endoftext|> b", " " * 5000 + "a" + "\n" * 3000]
    assert [own.ids(t).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    frame = documents(spark, ["a b", "a b"]).selectExpr("cast(null as long) AS doc_id", "text", "text AS pair")
    rows = alignment.token_alignment(frame, A, B).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].count_sum == 2 * rows[0].n_links
    assert alignment.token_alignment(documents(spark, []), A, B).collect() == []


def test_groups_equal_a_plain_merge():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 80)
        a, b = ([x for x in range(1, n) if rng.random() < rng.choice([0.5, 0.95])] + [n] for _ in range(2))
        groups, left, right = alignment.irregular(a, b)
        cuts = sorted(set(a) & set(b))
        want = []
        for start, end in zip([0, *cuts], cuts):
            sides = [[k for k, e in enumerate(side) if start < e <= end] for side in (a, b)]
            if len(sides[0]) + len(sides[1]) > 2:
                want.append((sides[0][0], sides[0][-1] + 1, sides[1][0], sides[1][-1] + 1))
        assert groups == want
        overlap = lambda x, y: max(a[x - 1] if x else 0, b[y - 1] if y else 0) < min(a[x], b[y])
        pairs = [(x, y) for s, e, t, f in groups for x in range(s, e) for y in range(t, f) if overlap(x, y)]
        assert sorted(zip(left, right)) == sorted(pairs)
