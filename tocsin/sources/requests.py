"""Incident requests: JSON lines, in batch and as a stream, and whole log files.

All readers use one exact parser.  No line is lost: what is no request keeps
its place and the reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.functions.rows import computed_once
from tocsin.operators.validation import as_text, check_requests, parse_object, part_of
from tocsin.session import shared_folder
from tocsin.sources import ranges

# Texts read as a whole number.
WHOLE_TEXT = r"\A\s*[+-]?[0-9]+(\.0+)?\s*\z"
FIELDS = ["service_name", "environment", "log_payload", "max_context_lines"]
# Reasons of lines that hold no JSON object, or are too long to hold a request.
BROKEN, TOO_LONG = "json", "line_length"
# A payload of the longest size takes at most 12 bytes a character in JSON; longer lines are not parsed.
LONGEST_LINE = 12 * schemas.PAYLOAD_MAX + (1 << 20)
# A file of more bytes holds more characters than a payload may.
LONGEST_FILE = 4 * schemas.PAYLOAD_MAX
FILES_PER_BATCH = 64


def text_key(*parts: Column) -> Column:
    """256 bits, as 64 hexadecimal digits, of some values; null differs from every text, and no two lists look alike."""
    marked = [
        F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-"))
        for p in parts
    ]
    return F.sha2(F.concat(*marked), 256)


def parsed_requests(lines: DataFrame) -> DataFrame:
    """Requests, with ``errors``, of the lines that ``ranges.read_lines`` gives.

    A request's id is the one it gives, as text, or else a key of all it says and
    of its line's place, so equal lines have ids of their own and reading again
    gives the same ids.  An absent window is 10, a null one is wrong.  A line that is no JSON
    object has the error ``json``; one that is too long is not parsed.  Blank
    lines are no requests and are left out.
    """
    names = ["request_id", *FIELDS]
    given = lines.where(F.col("value").isNull() | (F.btrim("value", F.lit(" \t\r\n")) != ""))
    parsed = parse_object(given.withColumn("_line", F.btrim("value", F.lit(" \t\r\n"))), "_line")
    parts = computed_once(parsed, {f"_{n}": F.expr(part_of("_parsed", n)) for n in names})
    window = F.col("_max_context_lines")
    number = F.try_variant_get(window, "$", "double")
    kind, text = F.schema_of_variant(window), F.try_variant_get(window, "$", "string")
    numeric = kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|BOOLEAN)$") & (number == F.rint(number))
    whole = F.when(numeric | ((kind == "STRING") & text.rlike(WHOLE_TEXT)), number.try_cast("bigint"))
    values = {
        "request_id": F.try_variant_get("_request_id", "$", "string"),
        **{n: F.expr(as_text(f"_{n}", f"schema_of_variant(_{n})")) for n in FIELDS[:3]},
        "max_context_lines": F.when(
            window.isNull() & F.col("_parsed").isNotNull(), schemas.WINDOW_DEFAULT
        ).otherwise(whole),
    }
    place = ["path", "offset", "n_bytes", "arrived"]
    told = F.when(F.col("_parsed").isNull(), F.col("value"))
    read = computed_once(parts, values).select(*names, *place, F.col("_parsed").isNull().alias("_broken"), told.alias("_told"), F.col("value").isNull().alias("_long"))
    keyed = read.withColumn("request_key", text_key(*(F.col(c) for c in ("request_id", *FIELDS, "_told", "path", "offset"))))
    keyed = keyed.withColumn("request_id", F.coalesce("request_id", "request_key"))
    checked = check_requests(keyed)
    errors = F.when(F.col("_long"), F.array(F.lit(TOO_LONG))).when(F.col("_broken"), F.array(F.lit(BROKEN)))
    return checked.select(*names, "request_key", *place, F.coalesce(errors, F.col("errors")).alias("errors"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the files below a folder, as ``parsed_requests`` gives them."""
    return parsed_requests(ranges.read_lines(ranges.files_in(spark, path), longest=LONGEST_LINE))


def stream_requests(
    spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH, tasks: int | None = None
) -> DataFrame:
    """The same as an unbounded input: files that arrive in a folder.

    Lines of a batch are read by ``tasks`` tasks, as many as a shuffle has by default.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = ranges.files_arriving(spark, path, files_per_batch)
    return parsed_requests(ranges.read_lines(files, longest=LONGEST_LINE, tasks=tasks))


def log_files(spark: SparkSession, folder: str, longest: int = LONGEST_FILE) -> DataFrame:
    """One row per ``*.log`` file, with ``errors``: the file's stem names the service.

    A file of more than ``longest`` bytes, more characters than a payload may
    have, is not read: its payload is null and its error is ``log_payload``.  Empty files are not listed.
    ``scan_log_lines`` reads the lines of files of any size.
    """
    files = ranges.files_in(spark, folder, "*.log")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true")
    # The size is pushed to the source, which opens no file beyond it.
    read = content.load(folder).where(F.col("length") <= longest)
    read = read.select(*ranges.LISTED, F.decode("content", "UTF-8").alias("log_payload"))
    unread = files.where(F.col("length") > longest).withColumn("log_payload", F.lit(None).cast("string"))
    name = F.regexp_extract("path", r"([^/]*)\.log$", 1)
    rows = read.unionByName(unread).select(
        text_key(F.col("path")).alias("request_id"),
        name.alias("service_name"),
        F.lit("prod").alias("environment"),
        "log_payload",
        F.lit(schemas.WINDOW_DEFAULT).cast("bigint").alias("max_context_lines"),
        "path",
        F.col("length").alias("n_bytes"),
    )
    return check_requests(rows)


def scan_log_files(spark: SparkSession, folder: str) -> DataFrame:
    """One request per ``*.log`` file that is short enough for one."""
    return log_files(spark, folder).where(F.col("log_payload").isNotNull()).select("request_id", *FIELDS)


def scan_log_lines(spark: SparkSession, folder: str, size: int = ranges.RANGE) -> DataFrame:
    """path, service_name, line_no, raw of the lines of ``*.log`` files of any size.

    The lines of every range are counted first; a range's lines are then numbered on from
    the sum of the ranges before it, so no line is moved.  A stretch without LF of
    more bytes than a payload may have is one line without text.
    """
    cut = ranges.ranges_of(ranges.files_in(spark, folder, "*.log"), size)
    tasks = ranges.tasks_for(cut)
    path = shared_folder(spark, "ranges")
    ranges.count_lines(cut, tasks, LONGEST_FILE).write.parquet(path)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = spark.read.parquet(path).withColumn("first", F.coalesce(F.sum("n_lines").over(before), F.lit(0)))
    lines = ranges.number_lines(counted, tasks, LONGEST_FILE)
    return lines.withColumn("service_name", F.regexp_extract("path", r"([^/]*)\.log$", 1))
