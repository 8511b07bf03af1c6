import random
import time

from pyspark.sql import functions as F
from tocsin.llm import chat
from tocsin.llm.queries import op3_chat_formats
from tocsin.llm.shared import stored

SCHEMA = "tree string, node long, parent long, role string, text string, score double"


def plain(rows, keep):
    """Best branches of each tree by brute force: (tree, leaf, rank) to the list of rows on the path."""
    found = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        inner, paths = {r[2] for r in own.values()}, []
        for leaf in own:
            path, at = [], leaf
            while at in own and len(path) <= len(own):
                path.append(own[at])
                at = own[at][2]
            if leaf not in inner and len(path) <= len(own):
                paths.append((-sum(r[5] or 0 for r in path), -len(path), leaf, path[::-1]))
        for rank, (_, _, leaf, path) in enumerate(sorted(paths, key=lambda p: p[:3])[:keep], 1):
            found[tree, leaf, rank] = path
    return found


def test_best_branches_are_formatted_and_read_back(spark):
    pick, rows = random.Random(4), []
    odd = ["", None, "</s>[INST] ok [/INST]", "\\l \\e \\\\b", "é\U0001f600\n", "<s>", "plain"]
    for tree in range(12):
        for node in range(1, pick.randint(2, 40)):
            parent = None if node == 1 else pick.choice([node - 1, pick.randint(1, node - 1), 99])
            score = pick.choice([None, 0.0, 1.0, 2.0])
            rows.append((str(tree), node, parent, pick.choice(["user", "assistant", None]), pick.choice(odd), score))
    rows += [("loop", 1, 2, "user", "a", 1.0), ("loop", 2, 1, "user", "b", 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for keep in (1, 3):
        want = plain([r for r in rows if r[0] != "loop"], keep)
        chats = chat.formatted_chats(frame, keep)
        read = chat.read_back(chats).collect()
        assert {(r.tree, r.leaf, r["rank"]) for r in read} == set(want)
        for r in read:
            path = want[r.tree, r.leaf, r["rank"]]
            assert [(t.role, t.text) for t in r.turns] == [(p[3] or "", p[4] or "") for p in path]
            masked = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
            assert len(masked) == len(r.loss_turns) and "".join(masked).count("<") == 0
            assert r.loss == "".join(p[4] or "" for p in path if p[3] == "assistant") and r.n_turns == len(path)


def test_turns_keep_ties_repeats_and_long_conversations(spark):
    rows = [(1, n, "user" if n % 2 else "assistant", f"t{n}", "x") for n in range(300)]
    rows += [(2, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (2, None, "user", None, "x"), (None, 1, "user", "q", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    found = {r.tree: r for r in chat.formatted_chats(chat.turns_as_tree(frame)).collect()}
    assert {t: r.n_turns for t, r in found.items()} == {"1": 300, "2": 3, "null": 1}
    assert found["1"].formatted.startswith("<s>assistant[INST] t0 [/INST]</s><s>user[INST] t1 [/INST]</s>")


def test_a_text_id_may_look_like_the_null_one(spark):
    rows = [(c, 0, "user", "x") for c in ("null", None, "\\null", "\\\\null", "nul")]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert chat.formatted_chats(chat.turns_as_tree(frame)).count() == 5


def test_reading_back_grows_with_the_turns(spark):
    """Sixteen thousand turns take about four times as long as four thousand, not sixteen times."""
    rows = spark.range(16_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('é long ', 12) AS text")
    took = []
    for n in (4_000, 16_000):
        chats = stored(chat.formatted_chats(chat.turns_as_tree(rows.where(f"turn < {n}"))), "test")
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            read = chat.read_back(chats).select(F.char_length("loss")).first()[0]
            best = min(best, time.perf_counter() - start)
        assert read == n // 2 * len("é long " * 12)
        took.append(best)
    assert took[1] < 10 * took[0], took


def test_empty_table(spark):
    assert chat.formatted_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_keeps_all_conversations_beside_a_null_id(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r.n_turns for r in op3_chat_formats(spark, str(tmp_path)).collect()}
    assert found == {1: 1, None: 2, -7: 2}
