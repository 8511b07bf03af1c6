"""Small tables with nulls, repeated rows, odd texts and clashing extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, n_words long, fp string, key long, class string"


def documents(spark: SparkSession, texts, first: int = 0) -> DataFrame:
    """Documents numbered from ``first``; extra columns carry names that operators use inside."""
    rows = [(first + n, t, n, "x", n, "y") for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample(name: str) -> list:
    """All rows of a driver table at the smallest size, as tuples in column order."""
    import duckdb

    return duckdb.sql(f"SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'").fetchall()
