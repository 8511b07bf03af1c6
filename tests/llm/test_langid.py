import zlib

import numpy as np
from tocsin.llm import langid
from tocsin.llm.queries import op7_languages

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op7_languages(spark, FOLDER).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_kernel_is_the_cosine_of_ngram_sets():
    grams = np.unique(np.concatenate([c for t in (b"abcab", b"abd") for c in langid.codes(t)]))
    model = langid.Model("t", grams, np.zeros((1, len(grams))), np.zeros((1, 1)), ["x"])
    sets = langid.presence(model, ["ABCab", "abd", None])
    plain = [{t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)} for t in ("abcab", "abd")]
    assert sets.sum(axis=1).tolist() == [len(plain[0]), len(plain[1]), 0]
    assert (sets[0] * sets[1]).sum() == len(plain[0] & plain[1])


def test_margins_equal_kernel_ridge_regression_in_plain_code(spark):
    """With every row a landmark and all n-grams kept, the fit is the exact kernel ridge regression of weighted rows."""
    texts = ["the cat and the dog", "a dog sees", "one more thing", "der hund und die katze", "ein mensch", "le chat noir", "les chiens sont la"]
    langs = ["en", "en", "en", "de", "de", "fr", "fr"]
    rows = list(zip(range(7), texts, langs))
    model = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=30)
    names = ["de", "en", "fr"]
    assert model.languages == names and len(model.landmarks) == 7

    def grams(text):
        return {text.encode()[k : k + n] for n in (1, 2, 3) for k in range(len(text.encode()) - n + 1)}

    def kernel(a, b):
        return len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))

    # A language's rows weigh as much as those of any other.
    weigh = np.array([7 / 3 / langs.count(g) for g in langs])
    gram = np.array([[kernel(a, b) for b in texts] for a in texts])
    wanted = np.array([[1.0 if g == name else -1.0 for name in names] for g in langs])
    dual = np.linalg.solve(gram + langid.RIDGE * np.diag(1 / weigh), wanted)
    some = [*texts, "the dog", "katze und hund", "chat"]
    margins = np.array([[kernel(a, b) for b in texts] for a in some]) @ dual
    sets = langid.presence(model, some).astype(float)
    # N-grams that no labelled row has are not in a model's sets; the kernel's length counts them here.
    lengths = np.array([[np.sqrt(len(grams(t)))] for t in some])
    assert np.allclose((sets @ model.landmarks.T / lengths) @ model.weights, margins, atol=1e-4)
    share = model.scores(sets)
    assert (share.argmax(axis=1)[:7] == wanted.argmax(axis=1)).all() and np.allclose(share.sum(axis=1), 1)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(n, t, g, "x") for n, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    rows += [(None, "no id", "en", "x"), (20, None, "en", "x"), (21, "", None, "x"), (22, "12 :-)", "de", "x"), (23, "the dog", None, "x")]
    frame = spark.createDataFrame(rows, schema)
    model = langid.fitted(frame)
    assert model.languages == ["de", "en"]
    found = {r.doc_id: r for r in langid.identified(frame, model).collect()}
    assert [found[n].lang_pred for n in (0, 1, 20, 21, 22, 23)] == ["en", "de", "und", "und", "und", "en"]
    assert found[None].lang_pred == "en" and found[20].score == 0
    nothing = langid.identified(frame.limit(2), langid.fitted(frame.where("false")))
    assert [r.lang_pred for r in nothing.collect()] == ["und", "und"]
    kept = langid.accepted(frame.drop("score"), model, 0.35)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 12
    assert langid.identified(frame.where("false"), model).collect() == []


def test_every_language_with_a_letter_is_learnt(spark):
    kinds = "abcdefghijklmnopqrstuvwxyz"[:12]
    rows = [(100 * n + k, f"{c}{c}{c} {c}{c} " * 5, c) for n, c in enumerate(kinds) for k in range(n % 3 + 1)]
    rows += [(5000 + k, "12 :-)", "a") for k in range(200)] + [(6000, "?!", "no letters")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fitted(frame, rows=20)
    assert model.languages == list(kinds)
    found = {r.doc_id: r.lang_pred for r in langid.identified(frame, model).collect()}
    assert all(found[d] == c for d, t, c in rows if d < 5000)
