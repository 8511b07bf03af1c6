"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions are worked out exactly once per row.

    A later filter on such a column stays above this step.  With a plain
    projection the optimizer would copy the expression into the filter, for each
    mention of it, and a dump would be searched or an answer parsed many times.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = F.struct(*(column.alias(name) for name, column in columns.items()))
    return rows.select(*kept, F.inline(F.array(made)))
