import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.operators import logs

SEVERITIES = [
    ("FATAL: out of memory", "FATAL"),
    ("kernel panic now", "FATAL"),
    ("an Error and a Panic!", "FATAL"),
    ("[ERROR] x", "ERROR"),
    ("Traceback (most recent", "ERROR"),
    ("unhandled exception;", "ERROR"),
    ("WARN slow", "NOISE"),
    ("ERROR_CODE=3", "NOISE"),
    ("[IOError]", "NOISE"),
    ("OutOfMemoryError", "NOISE"),
    ("NullPointerException", "NOISE"),
    ("error5", "NOISE"),
    ("éerror", "NOISE"),
    ("fataĺ", "NOISE"),
    ("panıc", "NOISE"),
    ("tracebacK", "ERROR"),
    ("", "NOISE"),
]


def expected(text: str, width: int):
    """The stage by plain Python, for one dump."""
    lines = text.splitlines()
    for tier, words in (("FATAL", "FATAL|PANIC"), ("ERROR", "ERROR|EXCEPTION|TRACEBACK")):
        for n, line in enumerate(lines):
            if re.search(rf"\b({words})\b", line, re.I):
                kept = lines[max(0, n - width) : n + width + 1]
                context = "\n".join(kept)
                return len(lines), n, tier, context, len(kept), len(context) // 4
    return len(lines), None, None, None, 0, 0


def test_severity(spark):
    frame = spark.createDataFrame([(t,) for t, _ in SEVERITIES], "raw string")
    got = [r.severity for r in logs.tag_severity(frame).collect()]
    assert got == [s for _, s in SEVERITIES]


def crash_dump():
    return "\n".join(f"line {n}" if n != 4 else "FATAL gone" for n in range(9))


DUMPS = [
    (1, crash_dump(), 10),
    (2, "\n".join(f"[x] ok {n}" if n != 100 else "FATAL heap" for n in range(122)) + "\n", 10),
    (3, "\n".join(f"w {n}" if n != 500 else "ERROR no space" for n in range(601)), 10),
    (4, "\n".join(f"w {n}" if n != 15 else "FATAL" for n in range(30)), 5),
    (5, "INFO a\nERROR b\nFATAL c\nINFO d", 10),
    (6, "INFO a\nINFO b\nINFO c", 10),
    (7, "", 10),
    (8, "ERROR first\r\nx\x0by", 1),
    (9, "a\r\nb\r\nException last\r\n", 50),
    (10, "\n" * 300 + "ERROR at a block edge" + "\n" * 300, 50),
]


def dumps(spark):
    return spark.createDataFrame(DUMPS, "incident_id long, log_payload string, w long")


def stage(rows):
    return {
        r.incident_id: (r.n_lines, r.anchor, r.severity, r.context, r.n_context, r.est_tokens)
        for r in rows
    }


def test_dump_form(spark):
    got = stage(logs.preprocess_dumps(dumps(spark), F.col("w")).collect())
    assert got == {n: expected(text, w) for n, text, w in DUMPS}
    assert [got[n][1] for n in (1, 2, 3, 4, 5, 6)] == [4, 100, 500, 15, 2, None]
    assert [got[n][4] for n in (1, 2, 3, 4)] == [9, 21, 21, 11]


def test_line_form_equals_dump_form(spark):
    frame = dumps(spark)
    widths = F.create_map(*(F.lit(x) for n, _, w in DUMPS for x in (n, w)))
    lines = logs.dump_lines(frame).select("incident_id", "line_no", "raw")
    by_line = stage(logs.preprocess_lines(lines, widths[F.col("incident_id")]).collect())
    by_dump = stage(logs.preprocess_dumps(frame, F.col("w")).collect())
    assert by_line == {n: row for n, row in by_dump.items() if row[0] > 0}


def test_random_dumps(spark):
    rng = random.Random(3)
    words = ["ok", "error", "Fatal", "ERRORS", "panic", "x", "exception", "", "café"]
    breaks = ["\n", "\r\n", "\r", " ", "\x1c"]
    made = []
    for n in range(200):
        text = "".join(
            f"{rng.choice(words[:1] * 12 + words)} {k}{rng.choice(breaks)}" for k in range(rng.randint(0, 25))
        )
        made.append((n, text, rng.randint(1, 6)))
    frame = spark.createDataFrame(made, "incident_id long, log_payload string, w long")
    got = stage(logs.preprocess_dumps(frame, F.col("w")).collect())
    assert got == {n: expected(t, w) for n, t, w in made}
    for n, _, w in made:
        assert got[n][4] <= 2 * w + 1
        assert got[n][1] is None or expected(made[n][1], w)[1] == got[n][1]


def test_numbering_of_a_hot_key(spark):
    """Most records share a key, many share a second; numbers equal a plain row number."""
    frame = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 7).alias("incident_id"),
        F.timestamp_millis((F.col("id") * 7919 % 5000) * 37).alias("ts"),
        F.col("id").alias("event_id"),
    )
    plain = F.row_number().over(Window.partitionBy("incident_id").orderBy("ts", "event_id")) - 1
    for kind in ("timestamp", "timestamp_ntz"):
        numbered = logs.number_lines(
            frame.withColumn("ts", F.col("ts").cast(kind)), "incident_id", "ts", "event_id"
        )
        wrong = numbered.join(frame.select("event_id", plain.alias("want")), "event_id").filter("line_no <> want")
        assert numbered.count() == 5000 and wrong.count() == 0


def test_numbering_of_a_hot_second(spark, monkeypatch):
    """One second of one key holds nine tenths of all records; no window holds more than a small share of them."""
    frame = spark.range(40_000, numPartitions=4).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7).alias("incident_id"),
        F.timestamp_micros(
            F.when(F.col("id") % 10 < 9, 5_000_000 + F.col("id") * 7919 % 90).otherwise(F.col("id") * 1_000_003)
        ).alias("ts"),
        F.xxhash64("id").cast("string").alias("event_id"),
    )
    plain = F.row_number().over(Window.partitionBy("incident_id").orderBy("ts", "event_id")) - 1
    want = {(r.event_id, r.want) for r in frame.select("event_id", plain.alias("want")).collect()}
    monkeypatch.setattr(logs, "HOT_SECOND", 1000)
    numbered = logs.number_lines(frame, "incident_id", "ts", "event_id")
    assert {(r.event_id, r.line_no) for r in numbered.collect()} == want
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert any("row_number" in line and "_part" in line for line in plan.splitlines())
    second = frame.withColumn("_second", F.unix_seconds("ts")).filter("incident_id = 1 AND _second = 5")
    edges = logs._edges(second, ["incident_id", "_second"], "ts", "event_id").first()._edges
    below = second.select(F.sum(F.lit(0)), *(F.count_if(F.struct("ts", "event_id") <= F.struct(F.lit(e.ts), F.lit(e.event_id))).alias(f"c{n}") for n, e in enumerate(edges))).first()[1:]
    shares = [b - a for a, b in zip([0, *below], [*below, 36_000])]
    assert len(edges) == logs.EDGES and max(shares) < 36_000 / 8


def test_windows_out_of_range_are_refused(spark):
    lines = spark.createDataFrame([(1, 0, "ERROR x")], "incident_id long, line_no long, raw string")
    for width in (0, 51):
        with pytest.raises(Exception, match="1 to 50"):
            logs.preprocess_lines(lines, width).collect()


def test_one_long_incident(spark):
    """A single incident in very many blocks of lines keeps its whole window."""
    lines = spark.range(20000).select(
        F.lit(1).alias("incident_id"),
        F.col("id").alias("line_no"),
        F.when(F.col("id") == 10239, "FATAL here").otherwise(F.concat(F.lit("l"), "id")).alias("raw"),
    )
    row = logs.preprocess_lines(lines, 50).collect()[0]
    assert (row.anchor, row.n_context, row.n_lines) == (10239, 101, 20000)
    assert row.context.startswith("l10189\n") and row.context.endswith("\nl10289")


def test_line_form_without_broadcast(spark, monkeypatch):
    """The shuffled plan gives the same rows and is keyed by incident and block."""
    lines = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).alias("incident_id"),
        F.col("id").alias("raw_id"),
    )
    order = Window.partitionBy("incident_id").orderBy("raw_id")
    lines = lines.select(
        "incident_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("line_no"),
        F.when(F.col("raw_id") % 997 == 3, "ERROR e").otherwise(F.concat(F.lit("l"), "raw_id")).alias("raw"),
    )
    usual = sorted(map(str, logs.preprocess_lines(lines, 7).collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = logs.preprocess_lines(lines, 7)
        assert sorted(map(str, shuffled.collect())) == usual
        assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
        # With many anchors, lines are cut before they are shuffled; what is broadcast is marks, not anchors.
        monkeypatch.setattr(logs, "FEW_ANCHORS", 0)
        monkeypatch.setattr(logs, "MARKS", 8192)
        marked = logs.preprocess_lines(lines, 7)
        assert sorted(map(str, marked.collect())) == usual
        spans = logs._spans(logs.crash_anchors(logs.tag_severity(lines)), 7, "incident_id")
        blocked = lines.withColumn("_block", F.floor(F.col("line_no") / logs.BLOCK))
        near = logs.near_anchors(blocked, spans, "incident_id").count()
        named = blocked.join(spans.select("incident_id", "_block").distinct(), ["incident_id", "_block"]).count()
        assert named <= near <= named + 60000 * 60 / 8192 + 512 and near < 60000 / 2
        window = logs.context_window(lines, logs.crash_anchors(logs.tag_severity(lines)), 7)
        plan = window._jdf.queryExecution().executedPlan().toString()
        assert "_block" in plan[plan.index("SortMergeJoin") :].splitlines()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
