"""Log lines: split, tag, find the crash anchor, keep the lines around it.

There are two forms of the same stage.  The *dump form* works on one row per
dump and never shuffles, so it also runs inside a stream.  The *line form* works
on a table with one row per line, for logs too long for one row; its heavy
group (a single incident with very many lines) is spread over tasks, because
anchors are plain partial aggregates and the window join is keyed by incident
and block of line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin import schemas
from tocsin.functions.rows import computed_once
from tocsin.functions.text import line_pieces, line_total, quarter_length, split_lines
from tocsin.session import written

# The severity words and tiers.  Case is spelt out so that only
# ASCII letters (and the Kelvin sign, which folds to k) count as equal.
FATAL_WORDS = ["FATAL", "PANIC"]
ERROR_WORDS = ["ERROR", "EXCEPTION", "TRACEBACK"]
FATAL, ERROR, NOISE = "FATAL", "ERROR", "NOISE"

# Lines of a block; numbers that mark blocks with a window; anchors beyond which they are used.
BLOCK, MARKS, FEW_ANCHORS = 256, 1 << 21, 100_000
# Records of a key in one second beyond which the second is cut, and the places it is cut at.
HOT_SECOND, EDGES = 1 << 18, 64


def _any_word(words: list[str]) -> str:
    extra = {"K": "\\u212a"}
    spelt = ("".join(f"[{c}{c.lower()}{extra.get(c, '')}]" for c in word) for word in words)
    starts = "".join(f"{word[0]}{word[0].lower()}" for word in words)
    return rf"(?U)(?=[{starts}])\b(?:" + "|".join(spelt) + r")\b"


FATAL_PATTERN = _any_word(FATAL_WORDS)
ERROR_PATTERN = _any_word(ERROR_WORDS)


def _mentions(lowered: Column, words: list[str]) -> Column:
    """Cheap test on the stored bytes, so that most text never meets a regex."""
    test = lowered.contains(words[0].lower())
    for word in words[1:]:
        test = test | lowered.contains(word.lower())
    return test


def severity_of(raw: Column) -> Column:
    lowered = F.lower(raw)
    return (
        F.when(_mentions(lowered, FATAL_WORDS) & raw.rlike(FATAL_PATTERN), FATAL)
        .when(_mentions(lowered, ERROR_WORDS) & raw.rlike(ERROR_PATTERN), ERROR)
        .otherwise(NOISE)
    )


def dump_lines(dumps: DataFrame, payload: str = "log_payload") -> DataFrame:
    """One row per line, numbered from 0; the other columns are kept."""
    kept = [c for c in dumps.columns if c != payload]
    return dumps.select(*kept, F.posexplode(split_lines(F.col(payload))).alias("line_no", "raw")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def number_lines(
    records: DataFrame, key: str, moment: str, tie: str, name: str = "line_no"
) -> DataFrame:
    """Number the records of each key from 0 in order of time, then ``tie``.

    The numbering is worked out per key *and second*, on top of how many records
    the key had in earlier seconds.  A second of more than ``HOT_SECOND`` records
    of one key is cut further, at records that are sampled from it, so no task
    holds a whole key or a whole hot second.  Tables of no more records have none.
    """
    zoned = dict(records.dtypes)[moment] == "timestamp"
    second = F.unix_seconds(moment) if zoned else F.left(F.col(moment).cast("string"), F.lit(19))
    timed = records.withColumn("_second", second)
    group = [key, "_second"]
    counts = timed.groupBy(*group).agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") > HOT_SECOND)
    if records.count() > HOT_SECOND and not hot.isEmpty():
        edges = written(_edges(timed.join(hot.select(*group), group), group, moment, tie), "edges")
        place = F.struct(moment, tie)
        below = F.size(F.filter("_edges", lambda e: (e[moment] < place[moment]) | ((e[moment] == place[moment]) & (e[tie] <= place[tie]))))
        cut = F.when(F.col("_edges").isNull(), 0).otherwise(below)
        timed = timed.join(edges, group, "left").withColumn("_part", cut).drop("_edges")
        group = [*group, "_part"]
        counts = timed.groupBy(*group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group).orderBy(moment, tie)
    return (
        timed.join(starts, group)
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop(*group[1:], "_start")
    )


def _edges(records: DataFrame, group: list[str], moment: str, tie: str) -> DataFrame:
    """Per group some of its records' places, in order: those whose hashes are smallest, found before any shuffle."""
    drawn = Window.partitionBy(*group).orderBy(F.xxhash64(moment, tie), moment, tie)
    few = records.withColumn("_drawn", F.row_number().over(drawn)).filter(F.col("_drawn") <= EDGES)
    return few.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(moment, tie))).alias("_edges"))


def tag_severity(lines: DataFrame) -> DataFrame:
    return lines.withColumn("severity", severity_of(F.col("raw")))


def only_tier(tagged: DataFrame, tier: str) -> DataFrame:
    return tagged.filter(F.col("severity") == tier)


def crash_anchors(tagged: DataFrame, key: str = "incident_id") -> DataFrame:
    """Per key the first FATAL line, else the first ERROR line, else null.

    One hash aggregate with map-side combine; ``n_lines`` rides along.
    """
    first = {
        tier: F.min(F.when(F.col("severity") == tier, F.col("line_no"))) for tier in (FATAL, ERROR)
    }
    return (
        tagged.groupBy(key)
        .agg(
            first[FATAL].alias("_fatal"),
            first[ERROR].alias("_error"),
            F.count("*").alias("n_lines"),
        )
        .select(
            key,
            F.coalesce("_fatal", "_error").alias("anchor"),
            F.when(F.col("_fatal").isNotNull(), FATAL)
            .when(F.col("_error").isNotNull(), ERROR)
            .alias("anchor_severity"),
            "n_lines",
        )
    )


def _spans(anchors: DataFrame, window: Column | int, key: str) -> DataFrame:
    """The anchors' windows, a row for each block of line numbers that a window touches."""
    width = F.lit(window) if isinstance(window, int) else window
    return (
        anchors.filter(F.col("anchor").isNotNull())
        .select(
            key,
            "anchor",
            "anchor_severity",
            F.greatest(F.lit(0).cast("bigint"), F.col("anchor") - width).alias("_low"),
            (F.col("anchor") + width).alias("_high"),
        )
        .withColumn(
            "_block",
            F.explode(F.sequence(F.floor(F.col("_low") / BLOCK), F.floor(F.col("_high") / BLOCK))),
        )
    )


def near_anchors(lines: DataFrame, spans: DataFrame, key: str, marks: int | None = None) -> DataFrame:
    """Lines whose key and block some span names, and a few others, found where the lines lie.

    The blocks' hashes are numbers below ``marks``, so however many spans there are, no
    more than that many numbers are broadcast.  The lines need ``_block``.
    """
    marks = marks or MARKS
    mark = F.pmod(F.xxhash64(key, "_block"), F.lit(marks)).alias("_mark")
    known = spans.select(mark).distinct()
    return lines.withColumn("_mark", mark).join(F.broadcast(known), "_mark", "left_semi").drop("_mark")


def context_window(
    lines: DataFrame, anchors: DataFrame, window: Column | int, key: str = "incident_id", marked: bool = False
) -> DataFrame:
    """Lines from ``anchor - window`` to ``anchor + window``, both included.

    ``window`` may differ per anchor row.  Each anchor names the one or two
    blocks of line numbers its window touches, and lines meet anchors on key and
    block.  Spark broadcasts the anchors when their measured size allows it and
    otherwise shuffles by (key, block), so no key lands in one task as a whole.
    For such many anchors ``marked`` first drops, in the scan's stage, lines of blocks
    without a window, so that hardly any other line is shuffled.
    """
    spans = _spans(anchors, window, key)
    blocked = lines.withColumn("_block", F.floor(F.col("line_no") / BLOCK))
    if marked:
        blocked = near_anchors(blocked, spans, key)
    return (
        blocked.join(spans, [key, "_block"])
        .filter(F.col("line_no").between(F.col("_low"), F.col("_high")))
        .drop("_block", "_low", "_high")
    )


def context_text(window_lines: DataFrame, key: str = "incident_id") -> DataFrame:
    """Window lines joined by LF in line order; a group holds at most 2w+1 lines."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "raw")))
    return window_lines.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda line: line["raw"]), "\n").alias("context"),
        F.count("*").alias("n_context"),
    )


def token_estimate(context: Column) -> Column:
    return F.coalesce(quarter_length(context), F.lit(0))


def preprocess_lines(
    lines: DataFrame, window: Column | int, key: str = "incident_id"
) -> DataFrame:
    """Line form of the whole stage; one row per key, nulls and 0 without anchor.  A window has 1 to 50 lines.

    Where there may be too many anchors to be broadcast whole, they are found first
    and written, and lines far from every anchor are dropped where they lie.
    """
    width = F.lit(window) if isinstance(window, int) else window
    allowed = width.between(schemas.WINDOW_MIN, schemas.WINDOW_MAX)
    width = F.when(allowed, width).otherwise(F.raise_error(F.lit("a window has 1 to 50 lines")).cast("bigint"))
    anchors, many = crash_anchors(tag_severity(lines), key), False
    if lines.count() > FEW_ANCHORS:
        anchors = written(anchors, "anchors")
        many = anchors.count() > FEW_ANCHORS
    near = context_window(lines.select(key, "line_no", "raw"), anchors, width, key, many)
    return anchors.join(context_text(near, key), key, "left").select(
        key,
        "n_lines",
        "anchor",
        F.col("anchor_severity").alias("severity"),
        "context",
        F.coalesce("n_context", F.lit(0)).alias("n_context"),
        token_estimate(F.col("context")).alias("est_tokens"),
    )


def preprocess_dumps(
    dumps: DataFrame, window: Column | int, payload: str = "log_payload"
) -> DataFrame:
    """Dump form of the whole stage; adds the result columns, drops the payload.

    A severity word never spans a line break, so the first match in the whole
    dump lies on the first line of that tier, and the breaks before it give the
    line number.  Each search is its own projection, hence done once per row.
    """
    width = F.lit(window) if isinstance(window, int) else window
    text = F.col(payload)
    found = (
        dumps.withColumn("_width", width)
        .withColumn("_lowered", F.lower(text))
        .withColumn(
            "_fatal",
            F.when(_mentions(F.col("_lowered"), FATAL_WORDS), F.split(text, FATAL_PATTERN, 2)),
        )
        .withColumn(
            "_error",
            F.when(
                ~F.coalesce(F.array_size("_fatal") == 2, F.lit(False))
                & _mentions(F.col("_lowered"), ERROR_WORDS),
                F.split(text, ERROR_PATTERN, 2),
            ),
        )
        .withColumn(
            "severity",
            F.when(F.array_size("_fatal") == 2, FATAL).when(F.array_size("_error") == 2, ERROR),
        )
        .withColumn(
            "_before",
            F.when(F.array_size("_fatal") == 2, F.col("_fatal")[0]).when(
                F.array_size("_error") == 2, F.col("_error")[0]
            ),
        )
        .withColumn("_pieces", line_pieces(text))
    )
    placed = found.withColumn("n_lines", line_total(F.col("_pieces")).cast("bigint")).withColumn(
        "anchor", (F.array_size(line_pieces(F.col("_before"))) - 1).cast("bigint")
    )
    low = F.greatest(F.lit(0).cast("bigint"), F.col("anchor") - F.col("_width"))
    high = F.least(F.col("n_lines") - 1, F.col("anchor") + F.col("_width"))
    sliced = placed.withColumn(
        "_kept",
        F.when(
            F.col("anchor").isNotNull(),
            F.slice("_pieces", (low + 1).cast("int"), (high - low + 1).cast("int")),
        ),
    ).withColumn("context", F.array_join("_kept", "\n"))
    kept = [c for c in dumps.columns if c != payload]
    n_context = F.when(F.col("anchor").isNull(), 0).otherwise(F.array_size("_kept"))
    results = {
        **{name: F.col(name) for name in ("n_lines", "anchor", "severity", "context")},
        "n_context": n_context.cast("bigint"),
        "est_tokens": token_estimate(F.col("context")),
    }
    return computed_once(sliced, results).select(*kept, *results)


def context_bound(preprocessed: DataFrame, window: Column) -> DataFrame:
    """Per window size the longest context and whether it keeps to 2w+1 lines."""
    bound = 2 * F.col("window") + 1
    return (
        preprocessed.withColumn("window", window)
        .groupBy("window")
        .agg(F.count("*").alias("incidents"), F.max("n_context").alias("longest"))
        .select("window", "incidents", "longest", (F.col("longest") <= bound).alias("within_bound"))
    )


def noise_reduction(preprocessed: DataFrame) -> DataFrame:
    """Share of input lines dropped, by the severity that was found."""
    return (
        preprocessed.groupBy(F.coalesce("severity", F.lit(NOISE)).alias("severity"))
        .agg(
            F.count("*").alias("incidents"),
            F.sum("n_lines").alias("lines_in"),
            F.sum("n_context").alias("lines_kept"),
        )
        .withColumn("reduction", 1 - F.col("lines_kept") / F.nullif("lines_in", F.lit(0)))
    )
