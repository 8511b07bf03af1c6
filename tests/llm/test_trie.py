import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tocsin.llm import trie
from tocsin.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, words long, depth string, high long"


def table(spark, rows):
    """Turns (conv_id, turn, role, text); extra columns carry names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute(rows) -> list[tuple]:
    """All nodes in plain code, with sums over subtrees by looking at every pair of nodes."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    found = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(trie.WORD, p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == path)))
        found.append(
            (
                min(convs),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(convs),
                sum(len(p) == len(path) + 1 for p in below),
                len(leaves),
                saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def result(spark, rows, tmp_path, repeat=1):
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op13_prefix_trie(spark, str(tmp_path))
    assert found.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(map(tuple, found.collect()), key=repr)


def branching(seed: int, convs: int, longest: int) -> list[tuple]:
    """Conversations that share beginnings: copies, branches at any depth, one very common first turn."""
    rng, rows, known = random.Random(seed), [], []
    for c in range(convs):
        turns = [("user", "hello there")] if rng.random() < 0.5 else []
        if known and rng.random() < 0.7:
            other = rng.choice(known)
            turns = other[: rng.randint(0, len(other))]
        if not rng.random() < 0.2:
            turns = turns + [(rng.choice(["user", "assistant"]), " ".join(rng.choices("a b cc d", k=rng.randint(0, 4)))) for _ in range(rng.randint(0, longest))]
        known.append(turns)
        rows += [(c * 3 - 30, n if rng.random() < 0.95 else None, r, t) for n, (r, t) in enumerate(turns)]
    return rows


ODD = [
    (None, 0, "user", "left out"),
    (100, None, None, None),
    (100, None, None, None),
    (100, 7, "", ""),
    (103, 0, "user", "a"),
    (103, 0, "user", "a"),
    (103, 0, "assistant", "b"),
    (-5, 3, "user", "x y"),
    (221, 0, "u", "one"),
    (222, 0, "u", "one"),
    (223, -4, "ser", "x"),
    (224, 0, "s", "erx"),
]


def test_equal_to_brute_force(spark, tmp_path):
    rows = branching(1, 150, 6) + [(10_000 + n, 0, "user", "copy") for n in range(50)] + ODD
    random.Random(2).shuffle(rows)
    assert result(spark, rows, tmp_path) == brute(rows)


def test_small_bands_blocks_shards_and_tiers_give_the_same(spark, tmp_path, monkeypatch):
    rows = branching(3, 60, 12) + [(5000, n, "user", f"w{n % 5}") for n in range(70)] + [(5001, n, "user", f"w{n % 5}") for n in range(50)] + ODD
    for name, value in (("BLOCK", 4), ("BAND", 3), ("MEMBERS", 2)):
        monkeypatch.setattr(trie, name, value)
    monkeypatch.setattr(trie.prefix_trie, "__defaults__", (20, 2))
    assert result(spark, rows, tmp_path) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark, tmp_path):
    lone = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "gone with the head") for c in lone]
    want = brute(rows)
    assert len(want) == 1 and want[0][3] == 3 and want[0][5] == 1
    assert result(spark, rows, tmp_path) == want


def test_empty_table(spark, tmp_path):
    assert result(spark, [], tmp_path) == []


@pytest.mark.parametrize("n", [0, 1, 2, 100, 50_000])
def test_slots_are_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    digests = rng.integers(-(2**63), 2**63 - 1, (2, n))
    if n > 50:
        digests[0, :40] = 7  # halves repeat
    table = trie.NodeTable(*digests)
    slots = table.slots(*digests)
    assert sorted(slots.tolist()) == list(range(n))
    assert (table.slots(*(digests + 1)) == -1).all()


def test_a_shard_holds_one_row_for_each_of_its_nodes():
    rows = pa.table(
        {
            "depth": [1, 2, 1, 2, 1],
            "high": [5, 6, 5, 7, 8],
            "low": [5, 6, 5, 7, 8],
            "above_high": [0, 5, 0, 5, 0],
            "above_low": [0, 5, 0, 5, 0],
            "saved": [10, 3, 0, 4, 1],
            "leaves": [0, 1, 0, 1, 1],
            "child": [1, 1, 0, 1, 1],
        }
    )
    found = {r["high"]: tuple(r.values())[2:] for r in trie.shard_sums(rows).to_pylist()}
    assert found == {0: (18, 3, 2), 5: (17, 2, 2), 6: (3, 1, 0), 7: (4, 1, 0), 8: (1, 1, 0)}


def test_a_hot_conversation_is_spread_over_tasks(spark):
    rows = table(spark, [(1, n, "user", "w") for n in range(20_000)] + [(n, 0, "user", "w") for n in range(2, 2000)])
    turns = trie.numbered_turns(rows)
    plan = turns._jdf.queryExecution().optimizedPlan().toString()
    assert all("block" in line for line in plan.splitlines() if "Window [" in line)
    assert turns.where("conv_id = 1").agg({"place": "max"}).first()[0] == 20_000
