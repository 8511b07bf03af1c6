"""Mixing sources to target weights that change during training.

Every source has a schedule: weights at equal steps of training time, straight
lines between them.  The schedule's integral is the source's weight in the whole
mix and gives its target of words; the integral up to a time, scaled to the
target, is what the mix has taken of the source by then.  A source's documents
stand in a fixed random order, one pass after the other.  The words before a
document are the demand at which it is needed, so the inverse of the integral is
its position in training, and a range sort by position is the curriculum.

A running sum over a source of any size is made in three parts: over the totals
of 256 coarse buckets of the random order, over those of the 256 buckets of each, and
within a bucket.  Nothing else is grouped by source but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import stored

# Weights at the beginning, the middle and the end of training; their integrals are 3, 1 and 2.
SCHEDULES = ((4.0, 3.0, 2.0), (0.5, 1.0, 1.5), (1.0, 2.5, 2.0))
WORD = r"[^\x20\x09-\x0D]+"
# Hexadecimal digits of a document's place in the random order that make its coarse bucket and its bucket.
COARSE, DIGITS = 2, 4


def weight(schedule: tuple[float, ...]) -> float:
    """Integral of a schedule over training time, from 0 to 1."""
    return sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) / (len(schedule) - 1)


def position(area: Column, schedule: tuple[float, ...]) -> Column:
    """Earliest time at which a schedule's integral grows beyond ``area``."""
    step, before, found = 1 / (len(schedule) - 1), 0.0, F.lit(None).cast("double")
    parts = []
    for n, (a, b) in enumerate(zip(schedule, schedule[1:])):
        parts.append((n * step, before, a, b))
        before += (a + b) / 2 * step
    for start, below, a, b in reversed(parts):
        more = area - F.lit(below)
        root = F.sqrt(F.lit(a * a) + F.lit(2 * (b - a) / step) * more)
        inside = F.when(more <= 0, F.lit(start)).otherwise(F.lit(start) + F.lit(2.0) * more / (F.lit(a) + root))
        found = F.when(area < F.lit(below + (a + b) / 2 * step), inside).otherwise(found)
    return found


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Each source with its place (from 0) by code points, null last: a range sort, and counts of its partitions."""
    rows = sizes.orderBy(F.asc_nulls_last("source")).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, "curriculum-sources").withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")
    return rows.join(parts, "_part").select(*sizes.columns, place.alias("place"))


def targets(sizes: DataFrame, schedules: tuple, share: float, most: int) -> DataFrame:
    """Targets of the sources: least of ``most`` times their size and their part of ``share`` of all words.

    What is above that is dealt to the others by weight, until none is above: one
    small aggregate for each round.
    """
    kind = F.col("place") % len(schedules)
    weights = F.element_at(F.array(*(F.lit(weight(s)) for s in schedules)), (kind + 1).cast("int"))
    rows = numbered_sources(sizes).select("*", kind.alias("schedule"), weights.alias("weight"))
    rows = stored(rows, "curriculum-weights")
    most_words = (F.col("source_size") * most).cast("double")
    words = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:
        full = most_words < level * F.col("weight")
        held, rest = rows.agg(F.sum(F.when(full, most_words)), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (words - (held or 0.0)) / rest if rest else level
    return rows.withColumn("target", F.least(most_words, F.lit(level) * F.col("weight")))


def curriculum(
    documents: DataFrame, schedules: tuple = SCHEDULES, share: float = 1.5, most: int = 2, with_text: bool = True
) -> DataFrame:
    """One row for each pass of a document, in order of training.

    Returns uid (of the input row), doc_id, source, size, source_size, target,
    pass, words and position, and with ``with_text`` the text of the pass.  A
    source's words add up to its target, rounded; the document that reaches it
    is cut there, its first words joined by single blanks.  A document that is
    not taken has one row without pass, position and text and 0 words, behind all others.

    A null text has no words; texts without words are not taken.  Null is a
    source like any other, the last.  Rows that repeat another are documents of
    their own; the random order depends on id and text only, so reruns and
    other layouts of the table agree.  Other columns are not looked at; an empty table
    gives no rows.
    """
    spelt = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    rows = documents.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(spelt.cast("binary")).alias("key"),
        *(["text"] if with_text else []),
    )
    rows = stored(rows, "curriculum-documents")
    slim = rows.select("uid", "named", F.substring("key", 1, DIGITS).alias("bucket"), "key", "size")

    sizes = rows.groupBy("named", "source").agg(F.sum("size").alias("source_size"))
    wanted = stored(targets(sizes, schedules, share, most), "curriculum-targets").drop("source", "place", "weight")
    totals = slim.groupBy("named", "bucket").agg(F.sum("size").alias("total"))
    totals = stored(totals.withColumn("coarse", F.substring("bucket", 1, COARSE)), "curriculum-buckets")

    def before(rows: DataFrame, within: list[str], place: str, name: str) -> DataFrame:
        earlier = Window.partitionBy(*within).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")

    coarse = totals.groupBy("named", "coarse").agg(F.sum("total").alias("total"))
    coarse = before(coarse, ["named"], "coarse", "_earlier").join(wanted, "named")
    buckets = before(totals, ["named", "coarse"], "bucket", "_before").join(coarse, ["named", "coarse"])
    buckets = buckets.withColumn("_before", F.col("_before") + F.col("_earlier")).drop("coarse", "_earlier")
    inside = Window.partitionBy("named", "bucket").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["named", "bucket"])

    goal = F.floor(F.col("target") + 0.5)

    def one_pass(number: Column) -> Column:
        start = number * F.col("source_size") + F.col("_before") + F.col("_inside")
        words = F.greatest(F.least(F.col("size"), goal - start), F.lit(0))
        part = start.cast("double") / goal
        times = [F.when(F.col("schedule") == n, position(part * F.lit(weight(s)), s)) for n, s in enumerate(schedules)]
        return F.struct(
            number.alias("pass"), words.alias("words"), F.when(words > 0, F.coalesce(*times)).alias("position")
        )

    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), one_pass), lambda p: p["words"] > 0)
    none = F.array(F.struct(F.lit(None).cast("long").alias("pass"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("double").alias("position")))
    placed = placed.select("uid", "source_size", "target", F.when(F.size(passes) > 0, passes).otherwise(none).alias("passes"))
    found = rows.drop("named").join(placed, "uid").withColumn("at", F.explode("passes"))
    columns = ["uid", "doc_id", "source", "size", "source_size", "target", "at.pass", "at.words", "at.position"]
    if with_text:
        cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("at.words").cast("int")), " ")
        text = F.when(F.col("at.words") == F.col("size"), F.col("text")).when(F.col("at.words") > 0, cut)
        columns.append(F.when(F.col("at.pass").isNotNull(), text).alias("text"))
    return found.select(*columns, "key").orderBy(F.asc_nulls_last("position"), "source", "key", "uid").drop("key")
