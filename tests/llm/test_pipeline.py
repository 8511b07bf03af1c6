import random

import corpus_pipeline
from pyspark.sql import functions as F
from tocsin.llm import shared
from tocsin.llm.shared import stored


def test_stages_catch_planted_cases_and_keep_clean_documents(spark):
    pick = random.Random(3)
    folder = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("length(text) > 150").first().text
    vocabulary = real.where("lang = 'en'").first().text.split()
    make = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    passage, clean = make(60), [make(200) for _ in range(20)]
    near = clean[0].split()
    near[100] = "changed"
    rows = {9000 + n: t for n, t in enumerate(clean)}
    rows |= {9100: clean[1], 9101: " ".join(near), 9102: None, 9103: "123 !", 9104: item}
    rows |= {9105: f"{make(90)} {passage} {make(90)}", 9106: f"{make(80)} {passage} {make(80)}"}
    added = [(d, t, "en", "planted", len(t or "")) for d, t in rows.items()]
    docs = real.unionByName(spark.createDataFrame(added, real.schema))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "test")
        assert docs.columns == real.columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {9102, 9103} & left["language"].keys() and set(rows) - {9102, 9103} <= left["language"].keys()
    assert 9100 not in left["near_duplicates"]
    assert passage not in left["passages"][9105] and len(left["passages"][9105].split()) == 180
    assert 9104 not in left["benchmark"]
    assert all(left["benchmark"][9002 + n] == t for n, t in enumerate(clean[2:]))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in rows} == left["benchmark"].keys()


def test_extra_columns_of_any_name_stay_as_they_are(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    names = "lang_pred score n_words kept_text removed_spans n_hit contaminated uid row _th _rank a.b".split()
    own = [F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names]
    odd = F.struct(F.lit(1).alias("a b"), F.array(F.lit("x")).alias("c:d")).alias("struct of, odd `names")
    docs = stored(docs.select("*", *own, odd), "test")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stored(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        assert all(tuple(r["struct of, odd `names"]) == (1, ["x"]) for r in rows)
    assert {r.doc_id for r in corpus_pipeline.sequences(spark, docs, folder).collect()} == {r.doc_id for r in rows}


def test_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "test")
    assert docs.collect() == []


def test_tables_of_a_finished_stage_are_removed(spark, tmp_path, monkeypatch):
    folder, work = "/root/testdata/sf0.001", tmp_path / "work"
    monkeypatch.setattr(shared, "shared_folder", lambda _, purpose: f"{work}/{purpose}-{len(list(work.glob('*')))}")
    work.mkdir()
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(80)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        left = {p.name.split("-")[0] for p in work.glob("*")}
        assert left <= [{"langid"}, {"simhash"}, {"substrings"}, set()][n]
    # An input that is not written yet keeps the tables it reads.
    lazy = corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{tmp_path}/0"), folder)
    corpus_pipeline.STAGES[2][1](spark, lazy, folder).count()
    assert lazy.count() > 0
