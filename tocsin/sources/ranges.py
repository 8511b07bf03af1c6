"""Text files of any size, read by byte ranges.

Files are listed with their sizes and without their content, in batch or as a
stream of arriving files.  Each file is cut into ranges; a range owns the lines
that begin in it, so ranges are read independently and every line has one place:
its file and the byte at which it begins, whatever the cluster or its settings.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tocsin.session import ship

# Bytes of a range, of one read, and of the longest line that is handed on.
RANGE, CHUNK, LONGEST = 64 << 20, 1 << 20, 64 << 20
# Bytes of lines in one batch, and lines in one batch.
BATCH, MANY = 2 << 20, 10_000

# What the file source says of a file; the content is left out, so it is not read.
LISTED = ["path", "length", "modificationTime"]
LINE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("arrived", T.TimestampType()),
    ]
)


def files_in(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length and time of the files below a folder; empty ones are not listed."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(folder).select(*LISTED)


def files_arriving(spark: SparkSession, folder: str, files_per_batch: int, glob: str = "*") -> DataFrame:
    """The same as a stream of files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
    reader = reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(*LISTED)


def system_of(path: str):
    """The file system of a path, any that Arrow knows, and the path in it."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file, for reading at any place."""
    system, place = system_of(path)
    return system.open_input_file(place)


def lines_of(file, start: int, stop: int, longest: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, bytes, line) of the lines that begin from ``start`` to ``stop`` - 1.

    Lines end with LF, which is not part of them.  Of a line of more than ``longest``
    bytes only the place and the size are given.
    """
    at = max(start - 1, 0)
    file.seek(at)
    # A line begins at ``start`` if an LF stands before it.
    skipping, kept, size, begin = start > 0, [], 0, start
    while True:
        if not skipping and not size and begin >= stop:
            return
        chunk = file.read(CHUNK)
        if not chunk:
            break
        pieces = chunk.split(b"\n")
        for n, piece in enumerate(pieces):
            ended = n + 1 < len(pieces)
            if skipping:
                at += len(piece) + ended
                if ended:
                    skipping, begin = False, at
                continue
            size += len(piece)
            at += len(piece) + ended
            if size <= longest:
                kept.append(piece)
            else:
                kept.clear()
            if ended:
                if begin >= stop:
                    return
                yield begin, size, b"".join(kept) if size <= longest else None
                kept, size, begin = [], 0, at
        if skipping and at >= stop:
            return
    if not skipping and size and begin < stop:
        yield begin, size, b"".join(kept) if size <= longest else None


def ranges_of(files: DataFrame, size: int = RANGE) -> DataFrame:
    """The files' columns, start and stop of every range; an empty file has none."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    cut = files.where("length > 0").select(*LISTED, F.explode(starts).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + size, F.col("length")))


def _in_tasks(ranges: DataFrame, tasks: int, schema: T.StructType, rows_of) -> DataFrame:
    """Rows that ``rows_of`` makes of each range, the last column text as bytes; ``tasks`` tasks share the ranges."""
    most_bytes, most_lines = BATCH, MANY
    types, names, text = [to_arrow_type(f.dataType) for f in schema], schema.names, schema.names.index("value") if "value" in schema.names else None

    def array(values, kind, place):
        if place != text:
            return pa.array(values, kind)
        try:
            return pa.array(values, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([v if v is None else v.decode("utf-8", "replace") for v in values], pa.string())

    def packed(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([array(c, k, n) for n, (c, k) in enumerate(zip(columns, types))], names)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    for made in rows_of(file, row):
                        rows.append(made)
                        held += 0 if text is None else len(made[text] or b"")
                        if held > most_bytes or len(rows) >= most_lines:
                            yield packed(rows)
                            rows, held = [], 0
        if rows:
            yield packed(rows)

    ship(ranges.sparkSession)
    # Ranges are a few bytes each; a number of tasks keeps Spark from putting them into one.
    return ranges.repartition(tasks, "path", "start").mapInArrow(run, schema)


def tasks_for(ranges: DataFrame) -> int:
    """A task for every range, up to the tasks of eight shuffles."""
    return min(max(ranges.count(), 1), 8 * int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_lines(files: DataFrame, size: int = RANGE, longest: int = LONGEST, tasks: int | None = None) -> DataFrame:
    """path, offset, n_bytes, value and arrived (the file's time) of the lines of all files.

    Bytes that are no UTF-8 become replacement characters.  A line of more than
    ``longest`` bytes has no value.
    """
    cut = ranges_of(files, size)

    def rows_of(file, row):
        for line in lines_of(file, row["start"], row["stop"], longest):
            yield row["path"], *line, row["modificationTime"]

    return _in_tasks(cut, tasks or tasks_for(cut), LINE, rows_of)


def pieces_of(line: bytes | None, end: str) -> list[bytes | None]:
    """The lines that breaks other than LF make of one; a CR before its end, LF or the end of the file, belongs to that."""
    return [None] if line is None else [p.encode() for p in (line.decode("utf-8", "replace") + end).splitlines()]


def count_lines(ranges: DataFrame, tasks: int, longest: int = LONGEST) -> DataFrame:
    """The ranges with ``n_lines``, the lines that begin in each."""
    names = ranges.columns

    def rows_of(file, row):
        n = 0
        for offset, size, line in lines_of(file, row["start"], row["stop"], longest):
            n += len(pieces_of(line, "\n" if offset + size < row["length"] else ""))
        yield *(row[c] for c in names), n

    return _in_tasks(ranges, tasks, T.StructType([*ranges.schema.fields, T.StructField("n_lines", T.LongType())]), rows_of)


def number_lines(ranges: DataFrame, tasks: int, longest: int = LONGEST) -> DataFrame:
    """path, line_no and value of the lines of ranges, counted on from each one's ``first``."""

    def rows_of(file, row):
        number = row["first"]
        for offset, size, line in lines_of(file, row["start"], row["stop"], longest):
            for piece in pieces_of(line, "\n" if offset + size < row["length"] else ""):
                yield row["path"], number, piece
                number += 1

    found = _in_tasks(ranges, tasks, T.StructType.fromDDL("path string, line_no long, value string"), rows_of)
    return found.withColumnRenamed("value", "raw")
