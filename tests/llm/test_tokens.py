import random

import public_tokenizers
import pytest
from helpers import documents, sample
from tokenizers import Tokenizer
from tocsin.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "a", "The", "'s", "'ll", "12", "é", tokens.SPECIAL, "\t", "\x1c", "\x85", "\xa0", " "]
PARTS += ["!", "日", "\r\n", " x", "\U0001f600", "<|", "\0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library_on_odd_texts(library):
    pick, encoder = random.Random(3), tokens.Encoder(PATH, lambda e: e.ids)
    for _ in range(5000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 12)))
        assert sum(encoder.values(text), []) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_full_tables_are_emptied_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    encoder = tokens.Encoder(PATH, len)
    text = " ".join(f"word{n}" for n in range(50))
    for _ in range(2):
        assert sum(encoder.values(text)) == len(library.encode(text, add_special_tokens=False))
    assert len(encoder.known) <= 60


def test_counts_of_a_table(spark, library):
    texts = [None, "", "a b", "a b", "x" * 40_000, "word " * 30_000, "tab\there", tokens.SPECIAL * 3]
    texts += [row[1] for row in sample("documents")]
    found = {r.doc_id: r for r in tokens.token_counts(documents(spark, texts), PATH, frequent=50).collect()}
    for n, text in enumerate(texts):
        want = len(library.encode(text or "", add_special_tokens=False))
        assert (found[n].n_bytes, found[n].n_tokens, found[n].over_limit) == (len((text or "").encode()), want, want > 1024)


def test_empty_table(spark):
    assert tokens.token_counts(documents(spark, []), PATH).collect() == []


def test_texts_without_blanks_are_counted_and_not_kept(spark):
    pick = random.Random(8)
    lines = ["".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(40)]
    library, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH, len)
    for text in lines:
        assert sum(encoder.values(text)) == len(library.encode(text, add_special_tokens=False))
        assert sum(encoder.values(f"a {text} b, {text}")) == len(library.encode(f"a {text} b, {text}", add_special_tokens=False))
    assert max(map(len, encoder.known)) <= tokens.SHORT and encoder.size < 10_000
    found = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(spark, lines), PATH).collect()}
    assert found == {n: len(library.encode(t, add_special_tokens=False)) for n, t in enumerate(lines)}
