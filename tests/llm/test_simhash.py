import random

import numpy as np
import xxhash
from helpers import documents, sample
from tocsin.llm import simhash


def plain(text):
    words = []
    for part in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split():
        words.append(part)
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        value |= (2 * ones > len(grams)) << bit
    return value


def reachable(prints):
    """Smallest position that chains of fingerprints within four bits reach, by brute force."""
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def edited(pick, text):
    words = text.split()
    for _ in range(pick.randint(1, 4)):
        words[pick.randrange(len(words))] = "zz"
    return " ".join(words)


def test_fingerprints_and_components_equal_brute_force(spark):
    pick = random.Random(5)
    texts = [row[1] for row in sample("documents")]
    texts += [edited(pick, texts[pick.randrange(40)]) for _ in range(200)]
    texts += [None, "", " \n", "one", "ONE", "a b c", "É é x y z"] + [texts[0]] * 30
    found = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [plain(t) for t in texts]
    assert [found[n].fingerprint for n in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[n].component_id for n in range(len(texts))] == reachable(prints)


def components(spark, prints, block):
    signed = [p - (p >> 63 << 64) for p in prints]
    links = simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long"), block).collect()
    place, label = {p: n for n, p in enumerate(signed)}, list(range(len(prints)))
    for link in links:
        assert (link.u ^ link.v).bit_count() <= 4 if (link.u ^ link.v) >= 0 else True
        a, b = label[place[link.u]], label[place[link.v]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_hot_keys_are_cut_into_blocks_without_losing_links(spark):
    pick = random.Random(7)
    center = pick.getrandbits(64)
    prints = {center}
    while len(prints) < 300:  # many near one another, some far
        value = center
        for bit in pick.sample(range(64), pick.randint(1, 9)):
            value ^= 1 << bit
        prints.add(value)
    prints |= {pick.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    want = reachable(prints)
    for block in (16, 64, 8192):
        assert components(spark, prints, block) == want


def test_few_links_are_sent_on_from_a_large_group(spark):
    pick = random.Random(8)
    prints = {0}
    while len(prints) < 1000:
        prints.add(sum(1 << b for b in pick.sample(range(64), 2)))
    rows = np.array(sorted(prints), np.uint64)
    assert len(simhash.forest(rows)) == len(rows) - 1


def test_every_near_pair_shares_a_key(spark):
    pick = random.Random(9)
    rows = []
    for n in range(200):
        a = pick.getrandbits(64)
        b = a
        for bit in pick.sample(range(64), 4):
            b ^= 1 << bit
        rows += [(n, a - (a >> 63 << 64)), (n, b - (b >> 63 << 64))]
    prints = spark.createDataFrame(rows, "pair long, fp long")
    keys = simhash.signatures(prints.select("fp")).join(prints, "fp")
    shared = keys.groupBy("pair", "key").count().where("count > 1").select("pair").distinct()
    assert shared.count() == 200


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    pick = random.Random(10)
    make = lambda: " ".join(f"w{pick.randrange(10**6)}" for _ in range(300))
    a, b, c, d = make(), make(), make(), make()
    near = "A0 " + a.split(" ", 1)[1]  # sorts before all others
    assert 0 < (plain(a) ^ plain(near)).bit_count() <= 4
    rows = [(3, a), (5, near), (5, b), (None, c), (None, c), (None, a), (None, d), (7, d), (None, None), (None, "")]
    rows += [(9, make()), (9, make()), (9, make())]
    frame = spark.createDataFrame([(*r, n, "x") for n, r in enumerate(rows)], "doc_id long, text string, uid long, fp string")
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    found = kept.collect()
    want = [(3, a), (5, b), (7, d), (None, c), *rows[10:]]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found if r.text))) == sorted(map(repr, want))
    assert sum(not r.text for r in found) == 1
    assert all(rows[r.uid] == (r.doc_id, r.text) and r.fp == "x" for r in found)


def test_empty_table(spark):
    assert simhash.one_of_each(documents(spark, [])).collect() == []
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_joins_around_a_hub_can_be_split(spark):
    """Both sides of every join are shuffled for it, so a hub of many neighbours is cut by Spark's skew join."""
    from tocsin.llm import components

    names = ["autoBroadcastJoinThreshold", "adaptive.skewJoin.skewedPartitionThresholdInBytes", "adaptive.advisoryPartitionSizeInBytes", "adaptive.skewJoin.skewedPartitionFactor"]
    before = {n: spark.conf.get(f"spark.sql.{n}") for n in names}
    edges = spark.range(1, 40_001, numPartitions=4).selectExpr("0L AS u", "id AS v")
    try:
        for name, value in zip(names, ("-1", "20000", "20000", "1.5")):
            spark.conf.set(f"spark.sql.{name}", value)
        joined = components._large(edges, "test")
        assert joined.count() == 40_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(f"spark.sql.{name}", value)
    found = components.components(edges.unionByName(spark.createDataFrame([(7, 50_000)], "u long, v long")), "test")
    assert found.where("root = 0").count() == 40_002
