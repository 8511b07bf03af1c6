import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.functions.rows import computed_once
from tocsin.operators import agents, answers, prompts
from tocsin.operators.governance import Rules
from tocsin.operators.validation import check_answers
from tocsin.plans import triage

GOOD = {
    "severity": {"severity_detected": "FATAL"},
    "diagnostic": {"root_cause": "r", "confidence_score": 0.5, "explanation": "e"},
    "remediation": {
        "remediation_command": "df -h",
        "command_type": "shell",
        "requires_human_approval": False,
        "runbook_steps": ["a"],
    },
    "postmortem": {},
    "unified": {
        "severity_detected": "ERROR",
        "root_cause": "r",
        "confidence_score": 1,
        "explanation": "",
        "remediation_command": "",
        "command_type": "none",
        "requires_human_approval": True,
    },
}
ABSENT = object()

# (agent, field, JSON value, value read or None for wrong)
FIELDS = [
    ("severity", "severity_detected", "fatal", None),
    ("severity", "severity_reasoning", "r" * 500, "r" * 500),
    ("severity", "severity_reasoning", "r" * 501, None),
    ("severity", "severity_reasoning", None, None),
    ("severity", "severity_reasoning", ABSENT, "Standard severity classification from log signatures."),
    ("diagnostic", "root_cause", "\U0001f600" * 280, "\U0001f600" * 280),
    ("diagnostic", "root_cause", "x" * 281, None),
    ("diagnostic", "root_cause", 5, None),
    ("diagnostic", "root_cause", ABSENT, None),
    ("diagnostic", "confidence_score", 0, 0.0),
    ("diagnostic", "confidence_score", 1, 1.0),
    ("diagnostic", "confidence_score", 1.0001, None),
    ("diagnostic", "confidence_score", -0.1, None),
    ("diagnostic", "confidence_score", " 0.5 ", 0.5),
    ("diagnostic", "confidence_score", "0.5d", None),
    ("diagnostic", "confidence_score", "nan", None),
    ("diagnostic", "confidence_score", True, 1.0),
    ("diagnostic", "confidence_score", None, None),
    ("diagnostic", "confidence_score", [0.5], None),
    ("diagnostic", "explanation", "e" * 501, None),
    ("remediation", "remediation_command", "", ""),
    ("remediation", "remediation_command", None, None),
    ("remediation", "command_type", "powershell", None),
    ("remediation", "requires_human_approval", "YES", True),
    ("remediation", "requires_human_approval", "off", False),
    ("remediation", "requires_human_approval", 1, True),
    ("remediation", "requires_human_approval", 0.0, False),
    ("remediation", "requires_human_approval", 2, None),
    ("remediation", "requires_human_approval", "maybe", None),
    ("remediation", "requires_human_approval", ABSENT, None),
    ("remediation", "runbook_steps", [], []),
    ("remediation", "runbook_steps", ABSENT, []),
    ("remediation", "runbook_steps", None, None),
    ("remediation", "runbook_steps", ["a", 1], None),
    ("remediation", "runbook_steps", ["a", None], None),
    ("remediation", "runbook_steps", [None], None),
    ("remediation", "runbook_steps", "a", None),
    ("postmortem", "summary", ABSENT, ""),
    ("postmortem", "summary", "s" * 501, None),
    ("postmortem", "contributing_factors", ["x"], ["x"]),
    ("postmortem", "preventive_actions", {"a": 1}, None),
    ("postmortem", "impact_assessment", "ok", "ok"),
    ("unified", "command_type", "kubectl", "kubectl"),
    ("unified", "explanation", ABSENT, None),
    ("unified", "extra", [1, {"a": 2}], "ignored"),
]


def test_fields(spark):
    rows = []
    for n, (agent, field, value, _) in enumerate(FIELDS):
        body = dict(GOOD[agent])
        body.pop(field, None)
        if value is not ABSENT:
            body[field] = value
        rows.append((n, agent, json.dumps(body)))
    frame = spark.createDataFrame(rows, "n int, agent string, answer_text string")
    for row in check_answers(frame, list(GOOD)).collect():
        agent, field, value, want = FIELDS[row.n]
        if want == "ignored":
            assert row.errors == []
        elif want is None:
            assert row.errors == [field], (field, value, row.errors)
        else:
            assert row.errors == [] and row[field] == want, (field, value, row[field])


TEXTS = [
    ('{"severity_detected": "ERROR"}', True),
    ('{"severity_detected": "ERROR"} {"severity_detected": "ERROR"}', False),
    ('{"severity_detected": "ERROR"} done', False),
    ('{"severity_detected": "ERROR"}, {"a": 1}', False),
    ('{"severity_detected": "ERROR"}] [{"a": 1}', False),
    ('[{"severity_detected": "ERROR"}]', False),
    ("not json", False),
    ('"text"', False),
    ("17", False),
    ("", False),
    (None, False),
]


def test_whole_text_must_be_one_object(spark):
    frame = spark.createDataFrame(
        [(n, "severity", t) for n, (t, _) in enumerate(TEXTS)], "n int, agent string, answer_text string"
    )
    for row in check_answers(frame, ["severity"]).collect():
        assert (row.errors == []) == TEXTS[row.n][1], TEXTS[row.n]
        assert row.errors in ([], ["json"])


FENCED = [
    ("{}", "{}"), ("```json\n{}\n```", "{}"), ("```{}```", "{}"), ("```json```{}", "{}"), (" \x1c```json {} ``` ", "{}"),
    ("```", ""), ("`````", "``"), ("``````", ""), ("```json", ""), ("{}``` x", "{}``` x"), ("json```", "json"),
    ("```JSON {}```", "JSON {}"), ("a ``` b", "a ``` b"),
]


def test_fences(spark):
    frame = spark.createDataFrame(FENCED, "raw_answer string, want string")
    for row in answers.strip_fences(frame).collect():
        assert row.answer_text == row.want, row.raw_answer


def attempt(incident, agent, number, primary, fallback=None, **more):
    row = dict.fromkeys(schemas.ATTEMPT.names) | {
        "incident_id": incident,
        "agent": agent,
        "attempt": number,
        "prompt": "p" * 41,
        "primary_text": primary,
        "fallback_text": fallback,
        "ms": 1.5,
    }
    return tuple((row | more)[n] for n in schemas.ATTEMPT.names)


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.ATTEMPT)


def test_transport_and_tokens(spark):
    rows = [
        attempt(1, "severity", 1, "a", "b", primary_prompt_tokens=5, fallback_prompt_tokens=9),
        attempt(2, "severity", 1, "", "b", primary_prompt_tokens=5, fallback_prompt_tokens=9),
        attempt(3, "severity", 1, None, "b", primary_prompt_tokens=5),
        attempt(4, "severity", 1, "  ", "b"),
        attempt(5, "severity", 1, None, ""),
    ]
    got = {r.incident_id: r for r in answers.choose_transport(table(spark, rows)).collect()}
    assert [(got[n].raw_answer, got[n].transport) for n in range(1, 6)] == [
        ("a", "primary"), ("b", "fallback"), ("b", "fallback"), ("  ", "primary"), (None, None),
    ]
    assert [got[n].reported_prompt_tokens for n in range(1, 6)] == [5, 9, 5, 0, 0]
    filled = answers.fill_tokens(answers.strip_fences(answers.choose_transport(table(spark, rows))))
    by_id = {r.incident_id: (r.prompt_tokens, r.completion_tokens) for r in filled.collect()}
    assert by_id[1] == (5, 0) and by_id[4] == (10, 0)


def chain(incident, skip=None, tokens=None):
    tokens = tokens or {"severity": 50, "diagnostic": 60, "remediation": 70, "postmortem": 80}
    return [
        attempt(incident, a, 1, json.dumps(GOOD[a]), primary_prompt_tokens=tokens[a], primary_completion_tokens=2)
        for a in answers.CHAIN
        if a != skip
    ]


def test_first_valid_attempt(spark):
    good, bad = json.dumps(GOOD["severity"]), "no"
    rows = [
        attempt(1, "severity", 2, good), attempt(1, "severity", 1, bad), attempt(1, "severity", 3, "{}"),
        attempt(2, "severity", 1, bad), attempt(2, "severity", 3, "{}"), attempt(2, "severity", 4, good),
        attempt(3, "severity", 1, None),
    ]
    read = answers.read_answers(table(spark, rows), ["severity"])
    got = {r.incident_id: r for r in answers.first_valid_attempts(read).collect()}
    assert got[1].attempt == 2 and got[1].last_error is None and got[1].tried == 3
    assert got[2].attempt is None and got[2].last_error == ["severity_detected"] and got[2].tried == 2
    assert got[3].last_error == [answers.NO_ANSWER]


def test_attempts_limit_is_shared(spark):
    rows = [attempt(1, "severity", n, "bad") for n in (1, 2, 3, 4)]
    rows.append(attempt(1, "severity", 5, json.dumps(GOOD["severity"])))
    read = answers.read_answers(table(spark, rows), ["severity"])
    assert answers.first_valid_attempts(read).collect()[0].attempt is None
    assert answers.first_valid_attempts(read, attempts=5).collect()[0].attempt == 5
    read = answers.read_answers(table(spark, rows), answers.CHAIN)
    assert answers.agent_chains(read, attempts=5).collect()[0].severity.severity_detected == "FATAL"


def test_chain_usage_and_dead_letters(spark):
    rows = chain(1) + chain(2, skip="remediation") + chain(3, skip="severity")
    chains = answers.agent_chains(answers.read_answers(table(spark, rows), answers.CHAIN))
    usage = answers.usage_totals(chains).collect()
    assert [(r.incident_id, r.prompt_tokens, r.completion_tokens, r.inference_ms) for r in usage] == [(1, 260, 8, 6.0)]
    incidents = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "incident_id long")
    letters = {r.incident_id: r.missing_agent for r in answers.unavailable(incidents, chains).collect()}
    assert letters == {2: "remediation", 3: "severity", 4: "severity"}


def test_chain_does_not_depend_on_row_order_or_repeats(spark):
    rows = chain(1) * 200 + chain(2)
    read = answers.read_answers(table(spark, rows).repartition(7), answers.CHAIN)
    assert answers.agent_chains(read).count() == 2


def test_usage_needs_no_texts(spark):
    rows = chain(1) + chain(2, skip="remediation") + chain(3, skip="severity")
    read = answers.read_answers(table(spark, rows), answers.CHAIN)
    slim, full = answers.chain_usage(read), answers.agent_chains(read)
    assert answers.usage_totals(slim).collect() == answers.usage_totals(full).collect()
    missing = lambda f: sorted(map(str, f.select("incident_id", answers.first_missing().alias("m")).collect()))
    assert missing(slim) == missing(full)
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    only = answers.agent_chains(read, agents=["severity"])
    assert only.columns == ["incident_id", "severity"] and only.count() == 2


def chain_model():
    """Answers each agent by the start of its prompt; what it says depends on the service."""
    starts = {prompts.TEMPLATES[agent][:20]: agent for agent in answers.CHAIN}
    good = {agent: json.dumps(GOOD[agent]) for agent in answers.CHAIN}

    def reply(prompt):
        agent = starts[prompt[:20]]
        if agent == "diagnostic" and "mail" in prompt:
            return "not json at all", 1, 1
        if agent == "remediation" and "shop" in prompt:
            return RuntimeError("gone")
        return good[agent], 1, 1

    return lambda asked: [reply(prompt) for prompt in asked]


def test_agents_run_in_turn_and_bad_answers_are_asked_again(spark, tmp_path):
    rows = [(n, s, "prod", "FATAL x", 5) for n, s in enumerate(["pay", "mail", "shop"])] + [(3, "calm", "prod", "x", 5)]
    incidents = triage.incidents_of(spark.createDataFrame(rows, schemas.REQUEST))
    model = chain_model()
    for _ in range(2):  # a rerun adds nothing
        ran = triage.run_agents(incidents, model, str(tmp_path / "run"), fallback=model)
        tried = {}
        for r in ran.collect():
            tried.setdefault((r.incident_id, r.agent), []).append(r.attempt)
        assert {k: sorted(v) for k, v in tried.items()} == {
            **{(0, agent): [1] for agent in answers.CHAIN},
            (1, "severity"): [1],
            (1, "diagnostic"): [1, 2, 3],
            (2, "severity"): [1],
            (2, "diagnostic"): [1],
            (2, "remediation"): [1],
        }
    complete = triage.chains_of(ran).filter(answers.is_complete()).collect()
    assert [r.incident_id for r in complete] == [0]


def late_model(folder):
    """Answers the first agent badly three times and well in the fourth attempt, the others at once."""
    starts = {prompts.TEMPLATES[agent][:20]: agent for agent in answers.CHAIN}
    good = {agent: json.dumps(GOOD[agent]) for agent in answers.CHAIN}

    def reply(prompt):
        agent = starts[prompt[:20]]
        late = agent == "severity" and not os.path.exists(f"{folder}/agent=severity/attempt=3/_SUCCESS")
        return ("no", 1, 1) if late else (good[agent], 1, 1)

    return lambda asked: [reply(prompt) for prompt in asked]


def test_a_run_with_five_attempts_reads_the_fourth_answer(spark, tmp_path):
    requests = spark.createDataFrame([(1, "pay", "prod", "FATAL x", 5)], schemas.REQUEST)
    folder = str(tmp_path / "run")
    ran = triage.run_agents(triage.incidents_of(requests), late_model(folder), folder, attempts=5)
    tried = sorted((answers.CHAIN.index(r.agent), r.attempt) for r in ran.collect())
    assert tried == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (2, 1), (3, 1)]
    assert triage.chains_of(ran, limit=5).filter(answers.is_complete()).count() == 1
    assert triage.usage_of(ran, 5).filter(answers.is_complete()).count() == 1
    assert triage.dead_letters_of(requests, ran, 5).collect() == []
    assert triage.reports_of(requests, ran, Rules(), 5).count() == 1
    assert triage.dead_letters_of(requests, ran).count() == 1


def test_a_run_that_was_broken_off_asks_nothing_twice(spark, tmp_path):
    rows = [(n, f"s{n}", "prod", "FATAL x", 5) for n in range(12)]
    incidents = triage.incidents_of(spark.createDataFrame(rows, schemas.REQUEST))
    folder, calls = str(tmp_path / "run"), tmp_path / "calls"
    calls.mkdir()
    good = chain_model()

    def model(asked):
        # The third agent's sixth call kills its task, once.
        assert len(asked) <= 2
        third = all("Cause:" in p and "Command:" not in p for p in asked)
        if third and not (calls / "broken").exists() and sum(1 for p in calls.iterdir() if "third" in p.name) == 4:
            (calls / "broken").write_text("")
            raise SystemExit("gone")
        for prompt in asked:
            name = hashlib.sha256(prompt.encode()).hexdigest()
            with open(calls / f"{name}{'-third' if third else ''}", "a") as file:
                file.write("x")
        return good(asked)

    with pytest.raises(Exception):
        triage.run_agents(incidents, model, folder, batch=2, concurrency=1)
    before = len(list(calls.iterdir()))
    assert (calls / "broken").exists() and 24 < before < 48
    ran = triage.run_agents(incidents, model, folder, batch=2, concurrency=1)
    assert ran.count() == 48 and triage.chains_of(ran).filter(answers.is_complete()).count() == 12
    assert [p.read_text() for p in calls.iterdir() if p.name != "broken"] == ["x"] * 48
    # Another run of the same folder asks nothing; one prompt that has changed is asked.
    assert triage.run_agents(incidents, model, folder).count() == 48
    rows[0] = (0, "other", "prod", "FATAL x", 5)
    changed = triage.incidents_of(spark.createDataFrame(rows, schemas.REQUEST))
    assert triage.run_agents(changed, model, folder, batch=2).count() == 48
    assert len(list(calls.iterdir())) == 48 + 1 + 4


def test_dumps_are_searched_once_in_a_run(spark, tmp_path):
    searched = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        searched.add(1)
        return text

    rows = spark.createDataFrame([(n, "pay", "prod", "FATAL x", 5) for n in range(3)], schemas.REQUEST)
    rows = computed_once(rows, {"log_payload": counted.asNondeterministic()("log_payload")}).select(schemas.REQUEST.names)
    triage.run_agents(triage.incidents_of(rows), chain_model(), str(tmp_path / "run"))
    assert searched.value == 3


def models():
    """Made inside a function, so that they are shipped by value."""

    def flaky(asked):
        out = []
        for prompt in asked:
            if "boom" in prompt:
                out.append(ConnectionError("down"))
            elif "fatal failure" in prompt:
                out.append(RuntimeError("gone"))
            else:
                out.append((f"answer to {prompt}", 3, 4))
        return out

    def broken_batch(asked):
        raise RuntimeError("not reachable")

    return {"none": None, "flaky": flaky, "broken": broken_batch}


@pytest.mark.parametrize("fallback", ["none", "flaky", "broken"])
def test_ask_model(spark, fallback):
    asked = spark.createDataFrame(
        [(1, "severity", "hi"), (2, "severity", "boom"), (3, "severity", "fatal failure")],
        "incident_id long, agent string, prompt string",
    )
    got = agents.ask_model(asked, models()["flaky"], models()[fallback]).collect()
    tries = {n: sorted(r.attempt for r in got if r.incident_id == n) for n in (1, 2, 3)}
    assert tries[1] == [1]
    assert tries[2] == ([1] if fallback == "broken" else [1, 2, 3])
    assert tries[3] == ([1, 2, 3] if fallback == "none" else [1])
    assert [r.primary_text for r in got if r.incident_id == 1] == ["answer to hi"]
    assert all(r.error for r in got if r.incident_id != 1)


def test_ask_model_with_acceptance(spark):
    asked = spark.range(20).select(
        F.col("id").alias("incident_id"), F.lit("severity").alias("agent"), F.lit("hi").alias("prompt")
    )
    got = agents.ask_model(asked, models()["flaky"], accept=lambda agent, text: False)
    assert got.count() == 60
