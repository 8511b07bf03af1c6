"""Helpers of the operators: tables on the way, and functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tocsin.session import shared_folder, ship

# Rows of a batch that are Python objects at one time, and rows of a batch sent back.
SLICE, OUT = 128, 2048


class Scratch:
    """The tables that ``stored`` writes inside a ``with`` block, to be removed when nothing reads them any more."""

    open: list[Scratch] = []

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.open.remove(self)

    def clear(self, reader: DataFrame) -> None:
        """Remove the tables, but for those that ``reader`` still reads."""
        spark, files = reader.sparkSession, reader.inputFiles() if self.paths else []
        kept = [p for p in self.paths if any(f"/{p.rsplit('/', 1)[-1]}/" in file for file in files)]
        for path in set(self.paths) - set(kept):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = kept


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage like a checkpoint, keeps columns prunable, and survives the
    loss of any executor, since the folder is shared.
    """
    path = shared_folder(frame.sparkSession, purpose)
    for scratch in Scratch.open[-1:]:
        scratch.paths.append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def least_power(rows: DataFrame, column: str, size: int) -> int:
    """The least power of two from which on at most ``size`` rows have so much in ``column``; 64 if there is none.

    Found from a histogram of at most 64 rows, so that what is then sent to the driver is bounded.
    """
    powers = rows.where(F.col(column) > 0).groupBy(F.floor(F.log2(column)).alias("power")).agg(F.count("*").alias("rows"))
    power, found = 64, 0
    for row in sorted(powers.collect(), key=lambda r: -r.power):
        found += row["rows"]
        if found > size:
            break
        power = row.power
    return power


def set_apart(frame: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with every column but doc_id and text under a name no operator uses, and the way back.

    The way back selects the frame's columns from a result and gives them their names again.
    """
    names = [c if c.lower() in ("doc_id", "text") else f"_extra_{n}" for n, c in enumerate(frame.columns)]
    return frame.toDF(*names), lambda result: result.select(*names).toDF(*frame.columns)


def typed(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def arrow_mapped(frame: DataFrame, schema: str | T.StructType, run: Callable) -> DataFrame:
    """``mapInArrow`` with the package's code on the executors; a task gives its buffers back at its end."""

    def released(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    ship(frame.sparkSession)
    return frame.mapInArrow(released, typed(schema))


def mapped(
    frame: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[..., Iterable[tuple]]]
) -> DataFrame:
    """Rows that a function makes of each row, a few at a time.

    ``make`` runs once per task and returns the function; the function gets the
    values of one row and returns the rows to send back.
    """
    fields = typed(schema)
    arrow = to_arrow_schema(fields)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        step, rows = make(), []
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    rows.extend(step(*row))
                    if len(rows) >= OUT:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return arrow_mapped(frame, schema, run)


def extended(frame: DataFrame, added: str, make: Callable[[], Callable[[list], Iterable[tuple]]]) -> DataFrame:
    """All columns of a frame, and columns made from ``text``, a few rows at a time.

    The function gets a list of texts and returns a row of added values for
    each.  Columns of the added names are replaced.
    """
    new = T.StructType.fromDDL(added)
    base = frame.drop(*new.names)
    fields = T.StructType([*base.schema.fields, *new.fields])
    arrow, position = to_arrow_schema(new), [c.lower() for c in base.columns].index("text")
    full = to_arrow_schema(fields)

    def run(batches):
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = zip(*step(part.column(position).to_pylist()))
                columns = [pa.array(c, f.type) for c, f in zip(rows, arrow)]
                old = [c.cast(f.type) for c, f in zip(part.columns, full)]
                yield pa.RecordBatch.from_arrays([*old, *columns], schema=full)

    ship(frame.sparkSession)
    return base.mapInArrow(run, fields)
