"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees.  Self-joins that double their reach (parents, then
grandparents, ...) give every node's depth and the score of its branch; the
best branches of each tree are chosen by their leaves; the same joins in
descending reach enumerate the nodes of the chosen branches only.  The number
of joins grows with the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.rows import computed_once
from tocsin.llm.shared import stored

# Fixed texts of the template.  Escapes leave none of their first characters in a text.
OPEN, TEXT, CLOSE, END = "<s>", "[INST] ", " [/INST]", "</s>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    """A text without characters that begin a control string."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees without branches: tree, conv_id, node, parent, role, text, score.

    A turn answers the one before it in order of turn; rows of one turn number
    are ordered by role and text, and each stays a turn.  A null conv_id is one
    conversation, the tree ``null``; a text id of that name gets a backslash in front.
    """
    name = F.col("conv_id").cast("string")
    named = F.when(name.rlike(r"^\\*null$"), F.concat(F.lit("\\"), name)).otherwise(F.coalesce(name, F.lit("null")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select(
        named.alias("tree"),
        "conv_id",
        F.col("node").cast("long").alias("node"),
        F.when(F.col("node") > 1, F.col("node").cast("long") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _reach(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors 1, 2, 4, ... above every node, and every node's depth and branch score."""
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    now = nodes.join(known, ["tree", "parent"], "left").select(
        "tree",
        "node",
        F.when(F.col("_known"), F.col("parent")).alias("above"),
        F.col("score").alias("total"),
        F.lit(1).cast("long").alias("depth"),
    )
    now, steps = stored(now, "chat-reach"), []
    largest = now.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while (1 << len(steps)) <= largest and not now.where("above is not null").isEmpty():
        steps.append(now.select("tree", "node", "above"))
        further = now.select(
            "tree",
            F.col("node").alias("above"),
            F.col("above").alias("_above"),
            F.col("total").alias("_total"),
            F.col("depth").alias("_depth"),
        )
        now = now.join(further, ["tree", "above"], "left").select(
            "tree",
            "node",
            F.col("_above").alias("above"),
            (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        )
        now = stored(now, "chat-reach")
    return steps, now.where("above is null")


def chosen_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, node, back: the nodes of each tree's best branches, leaf first.

    A branch is the path from a root to a leaf, scored by the sum of its nodes;
    ties go to the longer branch, then to the smaller leaf.  Nodes whose parent
    is not in the tree are roots; nodes on a cycle have no branch.
    """
    steps, ends = _reach(messages)
    inner = messages.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    leaves = ends.join(inner, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(best))
    paths = leaves.where(F.col("rank") <= keep).select(
        "tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("back")
    )
    for power, step in reversed(list(enumerate(steps))):
        here = F.struct("node", "back")
        up = F.struct(F.col("above").alias("node"), (F.col("back") + (1 << power)).alias("back"))
        paths = (
            paths.join(step, ["tree", "node"], "left")
            .select("tree", "leaf", "rank", F.explode(F.array(here, up)).alias("at"))
            .where("at.node is not null")
            .select("tree", "leaf", "rank", "at.node", "at.back")
        )
    return paths


def formatted_chats(messages: DataFrame, keep: int = 1) -> DataFrame:
    """One formatted conversation per chosen branch.

    ``messages`` has tree (text), node and parent (long, nodes unique in a
    tree), role, text and score.  Returns tree, leaf, rank, n_turns, formatted,
    loss_spans (start and length, in code points of ``formatted``, of every
    assistant text) and loss_turns (the places of those turns, from 0).  Null roles and texts are empty, a null score is 0; an
    empty table gives no row.  Other columns are not looked at.
    """
    words = messages.select(
        "tree",
        "node",
        F.coalesce("role", F.lit("")).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    rows = chosen_paths(messages, keep).join(words, ["tree", "node"])
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.select(
        "tree",
        "leaf",
        "rank",
        F.negative("back").alias("place"),
        (F.col("role") == LEARNT).alias("learnt"),
        F.char_length(head).alias("_head"),
        F.char_length("text").alias("_length"),
        F.concat(head, "text", F.lit(CLOSE + END)).alias("piece"),
    )
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))
    span = F.struct((F.col("_start") + F.col("_head")).alias("start"), F.col("_length").cast("long").alias("length"))
    turns = rows.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("place", "learnt", "piece", span.alias("span")))).alias("turns")
    )
    learnt = F.filter(F.transform("turns", lambda t, i: F.struct(t["learnt"], i.alias("turn"))), lambda t: t["learnt"])
    return turns.select(
        "tree",
        "leaf",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: t["span"]).alias("loss_spans"),
        F.transform(learnt, lambda t: t["turn"]).alias("loss_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, in order."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    shape = r"(?s)^<s>([^\[]*)\[INST\] (.*) \[/INST\]$"
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, shape, 1)).alias("role"), unescaped(F.regexp_extract(p, shape, 2)).alias("text")
        ),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Formatted conversations with ``turns`` (role, text) and ``loss``, all text under the loss mask, unescaped.

    A conversation is split once at its turns, and those under the mask are
    taken by their places: cutting each span out of the text would count its way
    from the beginning every time.  A span that is not as long as its turn's text is an error.
    """
    split = computed_once(chats, {"turns": read_turns(F.col("formatted"))})
    texts = computed_once(split, {"_loss": F.transform("loss_turns", lambda i: F.get("turns", i)["text"])})
    sizes = F.transform("_loss", lambda t: F.char_length(escaped(t)).cast("long"))
    same = F.transform("loss_spans", lambda s: s["length"]) == sizes
    loss = F.when(same, F.array_join("_loss", "")).otherwise(F.raise_error(F.lit("loss spans and turns differ")))
    return texts.withColumn("loss", loss).drop("_loss")
