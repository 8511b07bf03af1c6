"""Counts, percentiles, means and verdicts over a table of request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.functions.rounding import round_whole

# The percentiles and the two limits, both strict.
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
P95_LIMIT_MS = 1000.0
PROMPT_TOKEN_LIMIT = 3000

SUCCESS = 200
# Bits that each round of a selection finds, 64 in all.
DIGITS = (22, 21, 21)


def extract_metrics(responses: DataFrame, body: str = "body") -> DataFrame:
    """Read total time and prompt tokens from the response text of successes."""
    parsed = F.from_json(
        F.when(F.col("status_code") == SUCCESS, F.col(body)),
        "timing_ms STRUCT<total: DOUBLE>, token_usage STRUCT<prompt_tokens: BIGINT>",
    )
    return (
        responses.withColumn("_body", parsed)
        .withColumn("server_total_ms", F.col("_body.timing_ms.total"))
        .withColumn("prompt_tokens", F.col("_body.token_usage.prompt_tokens"))
        .drop("_body", body)
    )


def request_counts(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    good = F.count_if(F.col("status_code") == SUCCESS)
    return metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        good.alias("succeeded"),
        (F.count("*") - good).alias("failed"),
    )


def _look_up(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Add a per-group table's columns: by equi-join, or as one scalar without groups."""
    if by:
        return rows.join(table, by)
    told = table.select(F.struct(*table.columns)).scalar()
    return rows.withColumn("_told", told).select(*rows.columns, "_told.*")


def _ordered(bits: Column) -> Column:
    """Bits of a double to a number in the same order, and back."""
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def with_order_key(rows: DataFrame, value: str, name: str = "_key") -> DataFrame:
    """A whole number of 64 bits for a double, in the same order; both zeros are one, and NaN is the largest."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value) + F.lit(0.0))
    told = rows.withColumn(name, F.when(F.col(value).isNotNull(), bits.cast("bigint")))
    return told.withColumn(name, _ordered(F.col(name)))


def keyed_value(key: Column) -> Column:
    """The double that an order key stands for."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _ordered(key))
    return F.when(key.isNotNull(), bits.cast("double"))


def percentiles(
    metrics: DataFrame,
    by: list[str] | None = None,
    value: str = "wall_ms",
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """Exact nearest-rank percentiles of the successes of each group.

    Percentile p is the value at position ``min(n - 1, floor(n * p))``, from 0,
    of the ascending values, and 0.0 for a group without successes.  A group may
    hold most of the rows, and most of them one value or values very close to
    each other, so values are never ranked.  They are selected by radix: each
    round counts, before any shuffle, the values that share the bits found so far
    by their next bits; the counts, at most four million for each group
    and percentile, name the bits that hold the wanted position.
    """
    by, shares = by or [], shares or PERCENTILES
    good, names = F.col("status_code") == SUCCESS, range(len(shares))
    keyed = metrics.select(*by, F.when(good, F.col(value).cast("double")).alias("_value"))
    keyed = with_order_key(keyed, "_value").drop("_value")

    shift = 64 - DIGITS[0]
    cells = keyed.groupBy(*by, F.shiftright("_key", shift).alias("_cell")).agg(F.count("_key").alias("_here"))
    group = Window.partitionBy(*by)
    until = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cells.select(*by, "_cell", "_here", F.sum("_here").over(until).alias("_until"), F.sum("_here").over(group).alias("_n"))
    for i, p in enumerate(shares.values()):
        counted = counted.withColumn(f"_rank{i}", F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))))
    found = _found(counted, by, names, [F.lit(True) for _ in names])
    counts = found.select(*by, F.coalesce("_n", F.lit(0)).alias("succeeded"))
    for width in DIGITS[1:]:
        known, shift = shift, shift - width
        wanted = [c for i in names for c in (f"_cell{i}", f"_rank{i}")]
        # A group's wanted bits are a few numbers, so they may ride along in the key of the counts.
        rows = _look_up(keyed.filter(F.col("_key").isNotNull()), found.select(*by, "_n", *wanted), by)
        prefix = F.shiftright("_key", known)
        near = rows.withColumn("_prefix", prefix).filter(F.array_contains(F.array(*(f"_cell{i}" for i in names)), F.col("_prefix")))
        cells = near.groupBy(*by, "_n", *wanted, "_prefix", F.shiftright("_key", shift).alias("_cell")).agg(F.count("*").alias("_here"))
        until = Window.partitionBy(*by, "_prefix").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = cells.withColumn("_until", F.sum("_here").over(until))
        found = _found(counted, by, names, [F.col(f"_cell{i}") == F.col("_prefix") for i in names])
    told = [keyed_value(F.col(f"_cell{i}")).alias(name) for i, name in enumerate(shares)]
    found = found.select(*by, *told)
    joined = counts.join(found, by, "left") if by else _look_up(counts, found, by)
    return joined.select(*by, "succeeded", *(F.coalesce(p, F.lit(0.0)).alias(p) for p in shares))


def _found(counted: DataFrame, by: list[str], names: range, mine: list[Column]) -> DataFrame:
    """Per group and percentile the cell that holds its position, among cells that are its own, and the position in it."""
    picked = [F.max("_n").alias("_n")]
    for i in names:
        rank, before = F.col(f"_rank{i}"), F.col("_until") - F.col("_here")
        here = mine[i] & (rank >= before) & (rank < F.col("_until"))
        picked += [F.max(F.when(here, F.col("_cell"))).alias(f"_cell{i}"), F.max(F.when(here, rank - before)).alias(f"_rank{i}")]
    return counted.groupBy(*by).agg(*picked)


def token_means(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean (plain and to a whole number) and maximum of the successes' known tokens."""
    tokens = F.when(F.col("status_code") == SUCCESS, F.col("prompt_tokens"))
    mean = F.coalesce(F.avg(tokens), F.lit(0.0))
    return metrics.groupBy(*(by or [])).agg(
        mean.alias("mean_tokens"),
        round_whole(mean).cast("bigint").alias("mean_tokens_rounded"),
        F.coalesce(F.max(tokens), F.lit(0)).alias("max_tokens"),
    )


def latency_verdict(p95: Column) -> Column:
    return p95 < P95_LIMIT_MS


def token_verdict(max_tokens: Column) -> Column:
    return max_tokens < PROMPT_TOKEN_LIMIT


def verdicts(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    p95 = percentiles(metrics, by, shares={"p95": PERCENTILES["p95"]}).select(*by, "p95")
    return (
        _look_up(token_means(metrics, by), p95, by)
        .withColumn("p95_under_limit", latency_verdict(F.col("p95")))
        .withColumn("tokens_bounded", token_verdict(F.col("max_tokens")))
    )
