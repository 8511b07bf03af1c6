"""The trie of the prefixes of conversations, in node tables addressed by minimal perfect hashes.

A prefix's digest is the sum, in four parts of 32 bits, of the digests of its turns
with their places.  So running sums give the digests of all prefixes, those of
a conversation of any length in bands of places, and a prefix's parent is a
subtraction.  Distinct digests are the nodes.  Each node belongs to its smallest
member, and from there on down that conversation's path belongs to it too.

Sums over subtrees come from shards of conversations.  A shard enumerates its
distinct digests, gives each a slot by a minimal perfect hash (a slot holds the
digest it stands for, which every look-up verifies), scatters the values of the
nodes that belong to its conversations into flat arrays, and adds them up through the array of
parents' slots, deepest nodes first.  A node belongs to one shard, and with it the
whole path above, so sums of the shards' arrays are those of the trie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import arrow_mapped, least_power, ship, stored

WORD = r"[^\x20\x09-\x0D]+"
# Turn numbers that are ranked together, places of a band, rows of a shard, and ids of a block of members.
BLOCK, BAND, SHARD, MEMBERS = 1 << 10, 1 << 12, 1 << 18, 1 << 12
# Parents in the broadcast tier at most.
FREQUENT = 1 << 16
PARTS = range(4)
HALF = 1 << 32
EMPTY = hashlib.sha256(b"").hexdigest()


def _mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """64 bits that depend on all bits of a digest and on the level."""
    x = high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0x632BE59BD9B4E019 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class NodeTable:
    """Slots 0 to n - 1 for n distinct digests.

    On each level the digests that are alone at their place get a bit there, the
    others go on to the next level; a digest's slot is the number of bits before its own.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels, left, first = [], np.arange(len(high)), 0
        while len(left):
            size = 2 * len(left) + 1
            place = (_mixed(high[left], low[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, first - 1 + np.cumsum(alone)))
            first += int(alone.sum())
            left = left[~alone[place]]
        self.digests = np.empty((2, len(high)), np.int64)
        self.digests[:, self._place(high, low)] = high, low

    def _place(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(high), -1), np.arange(len(high))
        for level, (alone, slot) in enumerate(self.levels):
            place = (_mixed(high[left], low[left], level) % np.uint64(len(alone))).astype(np.int64)
            here = alone[place]
            slots[left[here]] = slot[place[here]]
            left = left[~here]
        return slots

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The digests' slots, -1 where the slot's own digest is another one."""
        slots = self._place(high, low)
        if self.digests.shape[1]:
            slots[(self.digests[0, slots] != high) | (self.digests[1, slots] != low)] = -1
        else:
            slots[:] = -1
        return slots


NODE_FIELDS = "high long, low long, saved long, leaves long, children long"


def shard_sums(rows: pa.Table) -> pa.Table:
    """Sums of one band of one shard: saved, leaves and children of every node in it and of the nodes just above.

    Rows are places of paths: depth, digest and parent's digest, and the values
    (saved, leaves, child) that the place brings to its node, zeros where it does not own it.
    """
    depth, high, low, above_high, above_low, saved, leaves, child = (
        rows.column(c).to_numpy() for c in ("depth", "high", "low", "above_high", "above_low", "saved", "leaves", "child")
    )
    keys = np.unique(np.stack([np.concatenate([high, above_high]), np.concatenate([low, above_low])], axis=1), axis=0)
    table = NodeTable(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
    own, above = table.slots(high, low), table.slots(above_high, above_low)
    n = len(keys)
    sums = np.zeros((3, n), np.int64)
    np.add.at(sums[0], own, saved)
    np.add.at(sums[1], own, leaves)
    np.add.at(sums[2], above, child)
    parent, level = np.full(n, -1), np.full(n, -1)
    parent[own], level[own] = above, depth
    # A band's first nodes bring their sums up only to the root; other bands hand theirs over place by place.
    first = depth.min() if depth.min() > 1 else 0
    order = np.argsort(-level, kind="stable")
    order = order[level[order] > first]
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for at in np.split(order, cuts):
        np.add.at(sums[0], parent[at], sums[0, at])
        np.add.at(sums[1], parent[at], sums[1, at])
    return pa.table([*table.digests, *sums], names=["high", "low", "saved", "leaves", "children"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), mark, words: every turn in order of its number, null first, then role and text.

    The mark is a digest of role and text.  Null roles and texts are empty; rows
    without a conv_id belong to no conversation and are left out.  Turns are
    ranked within blocks of numbers, behind the counts of earlier blocks.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK), F.lit(-(1 << 62))).alias("block"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(blocks, ["conv_id", "block"])
    spelt = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return ranked.select(
        "conv_id",
        (F.col("_before") + F.col("_rank")).alias("place"),
        F.md5(spelt.cast("binary")).alias("mark"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )


def with_heads(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the head of another one: their turns, and conv_id with length.

    Conversation c begins with the first h turns of conversation c - c mod
    ``every`` (all if it has fewer, none if it is not there), h = crc32(c) mod
    ``most``, and goes on with its own turns behind its first h.
    """
    known = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    known = stored(known.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("base"), taken), "trie-heads")
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("_there"))
    there = F.least("h", F.coalesce("_there", F.lit(0)))
    known = known.join(bases, "base", "left").select("conv_id", "base", "h", there.alias("k"), (there + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    known = stored(known, "trie-conversations")
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    front = known.where("k > 0").join(heads, "base").where("place <= h").select("conv_id", "place", "mark", "words", "length")
    own = turns.join(known.drop("base"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "mark", "words", "length")
    return front.unionByName(own), known.select("conv_id", "length")


def _half(upper: Column, lower: Column) -> Column:
    return F.shiftleft(upper % HALF, 32).bitwiseOR(lower % HALF)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, length, words, band, digests of the prefix and of its parent, and a check of its last turn."""
    mark = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), "mark").cast("binary"))
    parts = [F.conv(F.substring("_mark", 8 * k + 1, 8), 16, 10).cast("long").alias(f"p{k}") for k in PARTS]
    band = F.floor((F.col("place") - 1) / BAND).alias("band")
    rows = turns.select("*", mark.alias("_mark"), band)
    rows = rows.select("conv_id", "place", "band", "length", "words", F.xxhash64("_mark").alias("check"), *parts)
    rows = stored(rows, "trie-turns")
    bands = rows.groupBy("conv_id", "band").agg(*(F.sum(f"p{k}").alias(f"t{k}") for k in PARTS))
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("conv_id", "band", *(F.coalesce(F.sum(f"t{k}").over(earlier), F.lit(0)).alias(f"t{k}") for k in PARTS))
    inside = Window.partitionBy("conv_id", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("*", *(F.sum(f"p{k}").over(inside).alias(f"s{k}") for k in PARTS)).join(bands, ["conv_id", "band"])
    to = [F.col(f"s{k}") + F.col(f"t{k}") for k in PARTS]
    above = [s - F.col(f"p{k}") for k, s in zip(PARTS, to)]
    digests = (_half(to[0], to[1]).alias("high"), _half(to[2], to[3]).alias("low"), _half(above[0], above[1]).alias("above_high"), _half(above[2], above[3]).alias("above_low"))
    return sums.select("conv_id", F.col("place").alias("depth"), "length", "words", "band", "check", *digests)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """high, low, conv_id, depth, n_convs, leaf, saved of every node but the root; raises where digests collide."""
    found = rows.groupBy("high", "low").agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.max("length").alias("_longest"),
        F.min("depth").alias("depth"),
        F.min("words").alias("words"),
        F.min("check").alias("_first"),
        F.max("check").alias("_last"),
    )
    same = F.col("_first") == F.col("_last")
    depth = F.when(same, F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")))
    return found.select(
        "high",
        "low",
        "conv_id",
        depth.alias("depth"),
        "n_convs",
        (F.col("_longest") == F.col("depth")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )


def subtree_sums(rows: DataFrame, nodes: DataFrame, shard_rows: int) -> DataFrame:
    """high, low, saved, leaves, children of all nodes that have any, the root (0, 0) included."""
    owned = nodes.select("conv_id", "depth", "leaf", "saved", F.lit(1).cast("long").alias("child"))
    values = [F.coalesce(c, F.lit(0)).alias(n) for c, n in (("saved", "saved"), ("leaf", "leaves"), ("child", "child"))]
    head = ["conv_id", "band", "depth", "high", "low", "above_high", "above_low"]
    places = stored(rows.join(owned, ["conv_id", "depth"], "left").select(*head, "length", *values), "trie-places")
    n, longest = places.agg(F.count("*"), F.max("length")).first()
    if n and longest > BAND:
        # What the later bands of a path hold is handed to the last place of each band.
        later = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
        bands = places.where(F.col("length") > BAND).groupBy("conv_id", "band").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        handed = bands.select("conv_id", ((F.col("band") + 1) * BAND).alias("depth"), *(F.sum(c).over(later).alias(c) for c in ("saved", "leaves")))
        last = places.where((F.col("depth") % BAND == 0) & (F.col("length") > F.col("depth"))).drop("saved", "leaves", "child", "length")
        handed = last.join(handed, ["conv_id", "depth"]).withColumn("child", F.lit(0).cast("long"))
        places = places.drop("length").unionByName(handed)
    shards = max(1, -(-n // shard_rows))
    dealt = places.withColumn("shard", F.pmod(F.xxhash64("conv_id"), F.lit(shards)))
    ship(rows.sparkSession)
    sums = dealt.groupBy("shard", "band").applyInArrow(shard_sums, NODE_FIELDS)
    return sums.groupBy("high", "low").agg(*(F.sum(c).alias(c) for c in ("saved", "leaves", "children")))


def parents(rows: DataFrame, nodes: DataFrame, sums: DataFrame, frequent: int) -> DataFrame:
    """conv_id, depth, parent_conv_id where a conversation's own part of its path begins, deeper than 1.

    That is one node for each conversation; deeper ones have a parent of the
    same conversation.  Parents of the most children, at most ``frequent``, are
    broadcast; the others have fewer children and are joined.
    """
    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth")).where("depth > 1")
    first = first.join(rows.select("conv_id", "depth", "above_high", "above_low"), ["conv_id", "depth"])
    named = [F.col("high").alias("above_high"), F.col("low").alias("above_low")]
    power = least_power(sums, "children", frequent)
    often = F.coalesce(F.col("children") >= F.lit(2.0**power), F.lit(False))
    known = nodes.join(sums.select("high", "low", "children"), ["high", "low"]).select(*named, F.col("conv_id").alias("parent_conv_id"), often.alias("often"))
    found = first.join(F.broadcast(known.where("often").drop("often")), ["above_high", "above_low"], "left")
    found = stored(found, "trie-parents")
    rest = found.where("parent_conv_id is null").drop("parent_conv_id").join(known.where("not often"), ["above_high", "above_low"])
    columns = ["conv_id", "depth", "parent_conv_id"]
    return found.where("parent_conv_id is not null").select(*columns).unionByName(rest.select(*columns))


def ends(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """high, low, ends_sha256 of the nodes where conversations end: digest of their ids in order.

    Ids are joined to texts in blocks of numbers; a node's blocks stream through its digest one after the other.
    """
    none = F.lit(0).cast("long")
    turnless = conversations.where("length = 0").select(none.alias("high"), none.alias("low"), "conv_id")
    members = rows.where("depth = length").select("high", "low", "conv_id").unionByName(turnless)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = members.groupBy("high", "low", F.floor(F.col("conv_id") / MEMBERS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    blocks = blocks.repartition("high", "low").sortWithinPartitions("high", "low", "block").select("high", "low", "ids")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for high, low, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (high, low) == now:
                    digest.update(b"," + text.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (high, low), hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["high", "low", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], ["high", "low", "ends_sha256"])

    return arrow_mapped(blocks, "high long, low long, ends_sha256 string", run)


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard_rows: int = SHARD, frequent: int = FREQUENT) -> DataFrame:
    """One row for every distinct prefix of the conversations' turns, the empty one included.

    ``turns`` has conv_id, place (1, 2, ... without gaps), mark, words and length (of the
    conversation), as ``numbered_turns`` makes them; ``conversations`` has conv_id
    and length of each, 0 for those without turns.  Returns conv_id (the smallest
    member's; with depth it names the node and finds its text), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.  Without conversations there are no rows.
    """
    rows = stored(paths(turns), "trie-paths")
    nodes = stored(trie_nodes(rows), "trie-nodes")
    sums = stored(subtree_sums(rows, nodes, shard_rows), "trie-sums")
    everyone = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    columns = "high long, low long, conv_id long, depth long, n_convs long"
    root = [(0, 0, everyone.conv_id, 0, everyone.n_convs)] if everyone.n_convs else []
    every = nodes.select("high", "low", "conv_id", "depth", "n_convs").unionByName(rows.sparkSession.createDataFrame(root, columns))
    found = every.join(sums, ["high", "low"], "left").join(ends(rows, conversations), ["high", "low"], "left")
    found = found.join(parents(rows, nodes, sums, frequent), ["conv_id", "depth"], "left")
    above = F.when(F.col("depth") == 1, F.lit(everyone.conv_id).cast("long")).when(F.col("depth") > 1, F.coalesce("parent_conv_id", "conv_id"))
    childless = F.coalesce(F.col("children"), F.lit(0)) == 0
    return found.select(
        "conv_id",
        "depth",
        above.alias("parent_conv_id"),
        "n_convs",
        F.coalesce("children", F.lit(0)).alias("n_children"),
        F.when(childless, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
