"""Sources, prompts, reports and the stream, from requests to reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from test_answers import attempt, chain, table
from tocsin import schemas
from tocsin.operators import answers, prompts, reports
from tocsin.operators.governance import Rules
from tocsin.operators.validation import accepted, check_requests, quarantined, with_default_window
from tocsin.plans import inputs, queries, triage
from tocsin.sources import ranges
from tocsin.sources.requests import log_files, read_requests, scan_log_files, scan_log_lines, stream_requests
from tocsin.sources.sinks import write_escalations, write_report_texts, write_reports
from tocsin.streaming import triage as triage_stream
from tocsin.streaming import answers as late
from tocsin.streaming.answers import start_late_triage, stream_attempts
from tocsin.streaming.triage import committed, start_triage

SMALL = "/root/testdata/sf0.001"
REQUESTS = [
    (1, "pay", "prod", "INFO a\nFATAL b\nINFO c", 10),
    (2, "shop", "dev", "INFO a\nINFO b", None),
    (3, "mail", "staging", "ERROR x", 1),
    (4, "", "prod", "ERROR x", 1),
    (5, "a", "qa", "ERROR x", 51),
    (6, "s" * 128, "prod", "x", 50),
    (7, "s" * 129, "prod", "", 0),
]


def requests(spark):
    return spark.createDataFrame(REQUESTS, schemas.REQUEST)


def test_requests_checked_and_quarantined(spark):
    checked = check_requests(with_default_window(requests(spark)))
    errors = {r.request_id: r.errors for r in checked.collect()}
    assert [n for n, e in errors.items() if not e] == [1, 2, 3, 6]
    kept = accepted(with_default_window(requests(spark))).collect()
    assert sorted(r.request_id for r in kept) == [1, 2, 3, 6]
    assert quarantined(checked).filter("request_id = 7").count() == 3
    assert errors[5] == ["environment", "max_context_lines"]
    assert errors[7] == ["service_name", "log_payload", "max_context_lines"]


def test_payload_limit(spark):
    frame = spark.createDataFrame(
        [(n, "a", "prod", "é" * n, 10) for n in (2_000_000, 2_000_001)], schemas.REQUEST
    )
    assert [r.request_id for r in accepted(frame).collect()] == [2_000_000]


def test_json_requests(spark, tmp_path):
    lines = [
        '{"service_name": "a", "environment": "prod", "log_payload": "x"}',
        '{"service_name": "b", "environment": "prod", "log_payload": "x", "max_context_lines": null}',
        '{"service_name": "c", "environment": "prod", "log_payload": "x", "max_context_lines": "7"}',
        '{"service_name": "d", "environment": "prod", "log_payload": 5, "max_context_lines": 7.5}',
        '{"service_name": "e", "environment": "prod", "log_payload": "x", "max_context_lines": "1e1"}',
        "broken",
    ]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = {r.service_name: r for r in read_requests(spark, str(tmp_path)).collect()}
    assert got["a"].errors == [] and got["a"].max_context_lines == 10
    assert got["b"].errors == ["max_context_lines"]
    assert got["c"].errors == [] and got["c"].max_context_lines == 7
    assert got["d"].errors == ["log_payload", "max_context_lines"]
    assert got["e"].errors == ["max_context_lines"]
    assert got[None].errors == ["json"]
    assert len({r.request_id for r in got.values()}) == len(got)


def test_every_line_keeps_a_place_and_an_id(spark, tmp_path):
    good = '{"service_name": "a", "environment": "prod", "log_payload": "x"}'
    given = '{"request_id": 7, "service_name": "a", "environment": "prod", "log_payload": "x"}'
    lines = [good, good, "broken", "broken", "", given, given, '{"service_name": null}', "é\ud800".encode("utf-8", "surrogatepass").decode("latin-1")]
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_bytes("\r\n".join(lines).encode("latin-1"))
    rows = read_requests(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * (len(lines) - 1)
    assert len({r.request_key for r in rows}) == len(rows) == len({(r.path, r.offset) for r in rows})
    assert all(len(r.request_key) == 64 for r in rows)
    assert sorted(r.request_id for r in rows if r.request_id == "7") == ["7"] * 4
    assert len({r.request_id for r in rows}) == len(rows) - 3
    assert sum(r.errors == ["json"] for r in rows) == 6 and sum(r.errors == [] for r in rows) == 8
    again = read_requests(spark, str(tmp_path)).repartition(3).collect()
    assert {r.request_key for r in again} == {r.request_key for r in rows}


@pytest.mark.parametrize("size,chunk", [(1, 3), (7, 2), (16, 5), (1 << 20, 1 << 20)])
def test_ranges_hold_every_line_once(spark, tmp_path, monkeypatch, size, chunk):
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    files = {"a": b"one\ntwo\n\nfour", "b": b"\n\n", "c": b"", "d": b"x" * 40 + b"\nlast\n", "e": b"\xff\xfe\n\xc3\xa9"}
    for name, data in files.items():
        (tmp_path / f"{name}.log").write_bytes(data)
        own = []
        with open(tmp_path / f"{name}.log", "rb") as file:
            for start in range(0, len(data), size):
                own += ranges.lines_of(file, start, min(start + size, len(data)), 30)
        want, at = [], 0
        for line in data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]:
            want.append((at, len(line), line if len(line) <= 30 else None))
            at += len(line) + 1
        assert own == want, name
    found = ranges.read_lines(ranges.files_in(spark, str(tmp_path)), max(size, 4), 30).collect()
    assert sorted(r.value or "" for r in found) == sorted(["one", "two", "", "four", "", "", "", "last", "\ufffd\ufffd", "é"])


def test_log_lines_of_any_size_are_numbered_like_splitlines(spark, tmp_path):
    texts = {
        "plain": "INFO a\nFATAL b\n",
        "odd": "a\r\nb\rc\x0bd\x85\u2028e\n\n\r\nf\x1c",
        "none": "",
        "open": "x\ny",
        "long": "\n".join(f"line {n}\r" for n in range(500)),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    found = {}
    for r in scan_log_lines(spark, str(tmp_path), 16).collect():
        found.setdefault(r.service_name, {})[r.line_no] = r.raw
    assert {k: [v[n] for n in range(len(v))] for k, v in found.items()} == {
        k: t.splitlines() for k, t in texts.items() if t
    }


def test_files_too_long_for_a_request_are_not_read(spark, tmp_path):
    (tmp_path / "small.log").write_text("ERROR a\n")
    (tmp_path / "empty.log").write_text("")
    with open(tmp_path / "huge.log", "wb") as file:
        file.truncate(3 << 30)  # 3 GB of nothing, more than one row can hold
    got = {r.service_name: r for r in log_files(spark, str(tmp_path)).collect()}
    assert got["huge"].errors == ["log_payload"] and got["huge"].log_payload is None and got["huge"].n_bytes == 3 << 30
    assert set(got) == {"huge", "small"} and got["small"].errors == []
    assert {r.service_name for r in scan_log_files(spark, str(tmp_path)).collect()} == {"small"}


def test_log_files(spark, tmp_path):
    (tmp_path / "oom.log").write_text("INFO a\nFATAL b\n")
    (tmp_path / "disk.full.log").write_text("ERROR c")
    (tmp_path / "notes.txt").write_text("ERROR d")
    got = {r.service_name: r for r in scan_log_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"oom", "disk.full"}
    assert got["oom"].log_payload == "INFO a\nFATAL b\n" and got["oom"].environment == "prod"
    assert got["oom"].max_context_lines == 10
    found = {r.service_name: r.severity for r in triage.incidents_of(scan_log_files(spark, str(tmp_path))).collect()}
    assert found == {"oom": "FATAL", "disk.full": "ERROR"}


def test_prompts_are_filled_once(spark):
    frame = spark.createDataFrame(
        [("log {metadata} {context}", "pay é", "prod", "")],
        "context string, service_name string, environment string, command string",
    )
    fill = {"r": F.lit("{explanation}"), "e": F.lit("why")}
    row = frame.select(
        prompts.severity_prompt().alias("s"),
        prompts.remediation_prompt(fill["r"], fill["e"]).alias("r"),
        prompts.postmortem_prompt(F.lit("FATAL"), fill["r"], fill["e"], F.col("command")).alias("p"),
        prompts.diagnostic_prompt().alias("d"),
        prompts.metadata_json(F.col("service_name"), F.col("environment")).alias("m"),
    ).collect()[0]
    origin = json.dumps({"service_name": "pay é", "environment": "prod"})
    assert row.m == origin and row.s.endswith(origin)
    assert "log {metadata} {context}" in row.s and "Cause: {explanation}\nWhy: why" in row.r
    assert "Command: None" in row.p and "Service pay é in prod, graded FATAL" in row.p
    assert "of a FATAL incident" in row.d


def test_templates_come_from_a_table(spark):
    frame = spark.createDataFrame(
        [(1, "log {metadata}", "pay", "prod", 1), (2, "x", "pay", None, 2), (3, None, "a", "b", 1), (4, "x", "a", "b", 9)],
        "n int, context string, service_name string, environment string, v int",
    )
    table = prompts.template_rows(spark).unionByName(
        prompts.template_rows(spark, {"severity": "{context}{context} {environment}{not a name}{}", "unified": ""}, 2)
    )
    got = {
        r.n: r.prompt
        for r in prompts.prompts_from_table(frame, table, "severity", prompts.asked_values(), F.col("v")).collect()
    }
    single = {r.n: r.p for r in frame.select("n", prompts.severity_prompt().alias("p")).collect()}
    assert got == {1: single[1], 2: "xx unknown{not a name}{}", 3: None, 4: None}
    newest = prompts.prompts_from_table(frame, table, "unified", prompts.asked_values()).collect()
    assert [r.prompt for r in newest] == [""] * 4
    for rows in (
        [("severity", 1, "{root_cause}")],
        [("severity", 1, "a"), ("severity", 1, "b")],
        [("else", 1, "a")],
        [("severity", None, "a")],
        [("severity", 1, None)],
    ):
        with pytest.raises(Exception, match="template"):
            prompts.compiled(spark.createDataFrame(rows, schemas.TEMPLATE)).collect()
    for agent, body in prompts.TEMPLATES.items():
        assert {name for _, name in prompts.pieces(body) if name} <= set(prompts.QUOTABLE[agent])


def blocked_chain(incident):
    rows = chain(incident)
    proposal = {"remediation_command": "rm -rf /srv", "command_type": "shell", "requires_human_approval": False}
    return [r for r in rows if r[1] != "remediation"] + [attempt(incident, "remediation", 1, json.dumps(proposal))]


def all_attempts(spark):
    return table(spark, chain(1) + blocked_chain(3) + chain(2))


def test_reports(spark, tmp_path):
    made = triage.reports_of(requests(spark), all_attempts(spark), Rules())
    assert [f.name for f in made.schema.fields] == schemas.REPORT.names
    got = {r.service_name: r for r in made.collect()}
    assert set(got) == {"pay", "shop", "mail", "s" * 128}
    assert got["pay"].severity_detected == "FATAL" and got["pay"].remediation.command == "df -h"
    assert got["pay"].token_usage.prompt_tokens == 260 and got["pay"].timing_ms.inference == 6.0
    quiet = got["shop"]
    assert quiet.root_cause == reports.NO_ANCHOR["root_cause"] and quiet.confidence_score == 0.0
    assert quiet.remediation.command is None and quiet.token_usage.prompt_tokens == 0
    assert got["mail"].remediation.status == schemas.BLOCKED and got["mail"].remediation.command is None
    # The agent's severity is reported, not the one found in the dump.
    assert got["mail"].severity_detected == "FATAL"
    alarms = reports.escalations(made).collect()
    assert [a.service_name for a in alarms] == ["mail"]
    assert alarms[0].message == reports.ESCALATION % (got["mail"].incident_id, "mail", alarms[0].block_reason)
    write_reports(made, str(tmp_path / "p"))
    write_reports(made, str(tmp_path / "j"), "json")
    write_report_texts(made, str(tmp_path / "t"))
    write_escalations(made, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    texts = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert {t["service_name"] for t in texts} == set(got) and all(set(t) == set(schemas.REPORT.names) for t in texts)
    assert spark.read.json(str(tmp_path / "e")).count() == 1


def test_dead_letters(spark):
    letters = triage.dead_letters_of(requests(spark), table(spark, chain(1))).collect()
    assert [(r.incident_id, r.missing_agent) for r in letters] == [(3, "severity")]
    assert letters[0].detail == answers.UNAVAILABLE


def test_both_report_paths_agree(spark):
    incidents = triage.incidents_of(inputs.requests(spark, SMALL))
    chains = triage.chains_of(inputs.answers(spark, SMALL))
    apart = reports.no_anchor_reports(incidents).unionByName(reports.full_reports(incidents, chains, Rules()))
    together = reports.all_reports(incidents, chains, Rules())
    assert sorted(map(str, apart.collect())) == sorted(map(str, together.collect()))


def test_timing_column_is_rounded(spark):
    frame = spark.createDataFrame([(0.125, 2.675, 1.0, 0.375)], "a double, b double, c double, d double")
    block = frame.select(reports.timing_block(*(F.col(c) for c in "abcd")).alias("t")).collect()[0].t
    assert tuple(block) == (0.12, 2.67, 1.0, 0.38)


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests(spark).repartition(3).write.json(source)
    (tmp_path / "in" / "more.json").write_text('broken\n{"service_name": "b", "max_context_lines": null}\n')
    chains = triage.chains_of(all_attempts(spark))
    chains.write.parquet(str(tmp_path / "chains"))
    stored = spark.read.parquet(str(tmp_path / "chains"))

    def run():
        arriving = stream_requests(spark, source, files_per_batch=1)
        start_triage(arriving, stored, Rules(), out, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(map(str, committed(spark, out, "reports").select(*schemas.REPORT.names).collect()))

    batch = sorted(map(str, triage.reports_of(requests(spark), all_attempts(spark), Rules()).collect()))
    assert run() == batch
    assert committed(spark, out, "escalations").count() == 1
    assert committed(spark, out, "unavailable").count() == 0
    letters = {tuple(r.errors): r for r in committed(spark, out, "quarantine").collect()}
    assert set(letters) == {
        ("service_name",),
        ("environment", "max_context_lines"),
        ("service_name", "log_payload", "max_context_lines"),
        ("json",),
        ("environment", "log_payload", "max_context_lines"),
    }
    assert letters["json",].offset == 0 and letters["json",].path.endswith("more.json")
    # Accepted and rejected ones are all lines.
    assert len(batch) + len(letters) == len(REQUESTS) + 2
    assert run() == batch
    # A batch without its marker does not count.
    extra = committed(spark, out, "quarantine").drop("batch").limit(1)
    triage_stream.BatchTables(spark, out, 99).write(extra, "quarantine")
    assert committed(spark, out, "quarantine").count() == len(letters)


def write_attempts(spark, rows, path, moment):
    """One file of attempts that arrived at a time."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    names = schemas.ATTEMPT.names
    with open(path, "w") as file:
        file.writelines(json.dumps(dict(zip(names, row))) + "\n" for row in rows)
    os.utime(path, (moment, moment))


def test_answers_may_come_later_and_dead_letters_wait(spark, tmp_path):
    source, answered, out = (str(tmp_path / n) for n in ("in", "answers", "out"))
    os.makedirs(source)
    os.makedirs(answered)
    start = 1_700_000_000
    given = [{k: v for k, v in zip(schemas.REQUEST.names, r) if v is not None} for r in REQUESTS]
    lines = [json.dumps(r) for r in given] + ["broken"]
    (tmp_path / "in" / "one.json").write_text("\n".join(lines))
    os.utime(f"{source}/one.json", (start, start))

    def run():
        clock = (F.col("arrived"), F.col("arrived"))
        start_late_triage(
            stream_requests(spark, source, tasks=2),
            stream_attempts(spark, answered),
            Rules(),
            out,
            str(tmp_path / "checkpoint"),
            wait="10 minutes",
            clock=clock,
        ).awaitTermination()

    def names(kind, column="service_name"):
        return sorted(getattr(r, column) for r in committed(spark, out, kind).collect())

    first, second = chain(1)[:2], chain(1)[2:]
    write_attempts(spark, first + chain(99)[:1], f"{answered}/a.json", start + 60)
    run()
    quiet = ["s" * 128, "shop"]
    assert names("reports") == sorted(quiet) and len(committed(spark, out, "quarantine").collect()) == 4
    # A restart, and the rest of one incident's answers, some of which come twice.
    write_attempts(spark, second + first, f"{answered}/b.json", start + 120)
    run()
    assert names("reports") == sorted(["pay", *quiet])
    assert names("unavailable") == [] == names("orphans", "incident_id")
    # Half the wait is over for the others; then all of it.
    write_attempts(spark, chain(3)[:1], f"{answered}/c.json", start + 300)
    run()
    run()
    assert names("unavailable") == []
    write_attempts(spark, chain(98)[:1], f"{answered}/d.json", start + 3000)
    run()
    write_attempts(spark, chain(97)[:1], f"{answered}/e.json", start + 3001)
    run()
    letters = committed(spark, out, "unavailable").collect()
    assert [(r.service_name, r.missing_agent) for r in letters] == [("mail", "diagnostic")]
    assert names("orphans", "incident_id") == ["99"]
    batch = triage.reports_of(requests(spark), table(spark, chain(1)), Rules()).collect()
    got = committed(spark, out, "reports").select(*schemas.REPORT.names).collect()
    assert sorted(map(str, got)) == sorted(map(str, batch))


def test_waiting_ids_are_settled_by_one_aggregate(spark):
    """Times in milliseconds; the wait is 40, the latest clock 100."""
    some, all_four = (1, "s", None, None, None, None, None, None), (1, "s", 2, "d", 3, "r", 1, "p")
    before = spark.createDataFrame(
        [
            ("last answer", ["a"], False, 120, *all_four[:6], None, None),
            ("asked again", [], True, 120, *all_four),
            ("waits", ["b", "c"], False, 99, *some),
            ("dead", ["b", "c"], False, 98, *some),
            ("orphan", [], False, 98, *some),
            ("told", [], True, 98, *all_four),
            ("first request", [], False, 98, *some),
        ],
        late.STATE,
    )
    events = spark.createDataFrame(
        [
            ("last answer", "answer", 90, "postmortem", 2, "p2"),
            ("last answer", "answer", 90, "severity", 1, "again"),
            ("asked again", "open", 90, None, None, "new"),
            ("first request", "open", 90, None, None, "f"),
            ("answers", "answer", 70, "severity", 2, "s2"),
            ("answers", "answer", 80, "severity", 1, "s1"),
            ("line", "rejected", 90, None, None, "no"),
            ("calm", "quiet", 90, None, None, "yes"),
        ],
        "incident_id string, kind string, ms long, agent string, attempt int, body string",
    ).withColumn("clock", F.timestamp_millis("ms")).drop("ms")
    met = late.settled(before, events, 40, 100)
    got = {r.incident_id: r for r in met.collect()}
    ended = {k: r.outcome for k, r in got.items() if r.outcome}
    assert ended == {"last answer": "complete", "asked again": "complete", "dead": "dead", "orphan": "orphan"}
    assert (got["last answer"].severity, got["last answer"].postmortem_attempt) == ("s", 2)
    assert (got["answers"].severity, got["answers"].deadline, got["first request"].deadline) == ("s1", 110, 130)
    out = sorted((r.outcome, r.incident_id, r.incident or "") for r in late.outcomes_of(events, met).collect())
    assert out == [
        ("complete", "asked again", "new"),
        ("complete", "last answer", "a"),
        ("dead", "dead", "b"),
        ("dead", "dead", "c"),
        ("orphan", "orphan", ""),
        ("quiet", "calm", "yes"),
        ("rejected", "line", "no"),
    ]
    left = {r.incident_id: r for r in late.waiting(met).collect()}
    assert set(left) == {"last answer", "asked again", "waits", "first request", "answers"}
    assert left["last answer"].done and left["last answer"].incidents == [] and not left["waits"].done


def test_files_of_a_stream_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "documents.parquet")
    rows = [(n, f"line {n}", "web", "en") for n in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    frame.repartition(3).write.parquet(source)
    size = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))
    assert queries._stream_files(spark, str(tmp_path)) == queries.LEAST_FILES
    monkeypatch.setattr(queries, "FILE_BYTES", -(-size // 9))
    n_files = queries._stream_files(spark, str(tmp_path))
    assert n_files == 9
    written = queries._request_files(spark, str(tmp_path), n_files)
    counts = spark.read.text(written).groupBy(F.input_file_name()).count().collect()
    assert len(counts) == 9 and sum(r[1] for r in counts) == 900 and max(r[1] for r in counts) <= 110


def test_a_reader_hands_on_lines_in_small_batches(spark, tmp_path):
    import pyarrow as pa

    class Given:
        sparkSession = spark

        def repartition(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    path = tmp_path / "lines"
    path.write_bytes((b"x" * 9_999 + b"\n") * 1_500)

    def rows_of(file, row):
        for line in ranges.lines_of(file, 0, row["stop"], 1 << 20):
            yield row["path"], *line, None

    run = ranges._in_tasks(Given(), 1, ranges.LINE, rows_of)
    made = list(run([pa.RecordBatch.from_pylist([{"path": str(path), "stop": 15_000_000}])]))
    assert sum(b.num_rows for b in made) == 1_500 and max(b.nbytes for b in made) < 3 << 20


def test_keys_are_stable(spark):
    frame = requests(spark).withColumn("k", reports.request_key())
    first, again = ({r.request_id: r.k for r in f.collect()} for f in (frame, frame.repartition(5)))
    assert first == again and len(set(first.values())) == len(REQUESTS)
    assert all(len(k) == 36 for k in first.values())
