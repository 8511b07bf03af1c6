import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.operators import answers, governance, reports, screening
from tocsin.sources.rules import read_rules, rules_from, write_rules

RULES = governance.Rules()



def hits(pattern):
    """Texts that a deny pattern finds: one for each alternative of its group."""
    text = re.sub(r"\(\?!.*\)$", "", pattern).replace(r"\b", "").replace("$", "")
    group = re.search(r"(?<!\\)\(([A-Za-z|]+)\)", text)
    for part in group.group(1).split("|") if group else [None]:
        one = text[: group.start()] + part + text[group.end() :] if group else text
        for code, plain in ((r"\s+", " "), (r"\s*", ""), (r"\w+", "t1"), (".*", " q")):
            one = one.replace(code, plain)
        yield re.sub(r"\\(.)", r"\1", one)


def first_rule(command):
    """Position of the first deny pattern that the text matches, or None."""
    found = [n for n, p in enumerate(RULES.deny, 1) if re.search(p, command, re.IGNORECASE)]
    return found[0] if found else None


# Vectors made from the rule table: each hit as it is, in other case, with wide spacing, inside other
# text, and one letter short; then the edges of single rules.
MADE = [
    v
    for p in RULES.deny
    for h in hits(p)
    for v in (h, h.swapcase(), h.replace(" ", " \t "), f"x1 ; {h}", h[1:], h.replace(" ", ""))
]
EDGES = [
    "\u017fhutdown",
    "drop\nschema t1",
    "chown -R q /\nls",
    "DELETE FROM t WHERE a=1",
    "DELETE FROM t1 WHERE a=1",
    "rm -fr /",
    "format -rfx",
]
DENIED = [(c, "shell", first_rule(c)) for c in [*MADE, *EDGES]] + [("rm\x1c-rf\x1f/", "shell", None)]
PREFIXES = [(kind, p) for kind, ps in RULES.allow.items() if kind != "none" for p in ps]
MISSED = [(p[1:] + " x1", kind) for kind, p in PREFIXES] + [(p.swapcase() + " x1", kind) for kind, p in PREFIXES]
MISSED += [("kubectl get x1", "shell"), ("anything", "helm")]
APPROVED = [(p + suffix, kind, p) for kind, p in PREFIXES for suffix in ("", "x1", " x1")]
APPROVED = [(c, k, next(q for q in RULES.allow[k] if c.strip().startswith(q))) for c, k, _ in APPROVED if c == c.strip()]
APPROVED += [("\t SELECT 1 \n", "sql", "SELECT")]


def decide(spark, rows):
    frame = spark.createDataFrame(
        [(n, *row) for n, row in enumerate(rows)],
        "n int, remediation_command string, command_type string, requires_human_approval boolean, "
        "runbook_steps array<string>",
    )
    return [r for r in governance.decide(frame, RULES).orderBy("n").collect()]


def test_made_vectors_hit_their_rule():
    for pattern in RULES.deny:
        assert all(re.search(pattern, hit, re.IGNORECASE) for hit in hits(pattern)), pattern
    assert {n for _, _, n in DENIED} >= set(range(1, len(RULES.deny) + 1))


def test_deny(spark):
    for (command, kind, position), row in zip(
        DENIED, decide(spark, [(c, t, False, ["one"]) for c, t, _ in DENIED])
    ):
        want = RULES.deny[position - 1] if position else None
        # 0x1C to 0x1F are white space in a rule as well.
        want = RULES.deny[0] if "\x1c" in command else want
        assert row.governance.matched_denylist_pattern == want, command
        assert row.remediation.status == schemas.BLOCKED and row.remediation.command is None
        assert row.governance.guardrail_triggered
        if want:
            assert f"'{want}'" in row.remediation.block_reason
            assert row.remediation.runbook_steps == ["one"]
        else:
            assert row.remediation.runbook_steps == []


def test_allow_list(spark):
    for row in decide(spark, [(c, t, False, ["one"]) for c, t in MISSED]):
        assert row.remediation.status == schemas.BLOCKED and row.remediation.command is None
        assert row.remediation.runbook_steps == [] and row.governance.allowlist_verb is None
        assert row.remediation.block_reason == governance.NOT_ALLOWED
    approved = decide(spark, [(c, t, False, None) for c, t, _ in APPROVED])
    for (command, kind, verb), row in zip(APPROVED, approved):
        assert row.remediation.status == schemas.APPROVED and row.remediation.command == command.strip()
        assert row.governance.allowlist_verb == verb and not row.governance.guardrail_triggered


def test_approval_and_noop(spark):
    held, noop, empty, absent = decide(
        spark,
        [
            ("kubectl get pods", "kubectl", True, ["one"]),
            ("rm -rf /", "none", True, ["one"]),
            (" \x1f", "shell", True, None),
            (None, "sql", False, None),
        ],
    )
    assert held.remediation.status == schemas.BLOCKED and held.governance.allowlist_verb is None
    for row in (noop, empty, absent):
        assert row.remediation.status == schemas.APPROVED and row.remediation.command is None
        assert row.remediation.command_type == "none" and not row.governance.guardrail_triggered
    assert noop.remediation.runbook_steps == ["one"] and empty.remediation.runbook_steps == []


def test_answers_without_steps(spark):
    frame = spark.createDataFrame(
        [("df -h", "shell", False)],
        "remediation_command string, command_type string, requires_human_approval boolean",
    )
    row = governance.decide(frame, RULES).collect()[0]
    assert row.remediation.runbook_steps == [] and row.remediation.command == "df -h"


def test_rule_table_round_trip(spark, tmp_path):
    for kind in ("parquet", "json"):
        path = str(tmp_path / kind)
        write_rules(spark, RULES, path, kind)
        assert read_rules(spark, path, kind) == RULES


def test_rule_table_errors(spark, tmp_path):
    with pytest.raises(Exception):
        read_rules(spark, str(tmp_path / "absent"))
    for row in [("deny", None, 1, "("), ("deny", None, None, "a"), ("other", None, 1, "a"), ("allow", None, 1, "a")]:
        with pytest.raises(ValueError):
            rules_from(spark.createDataFrame([row], schemas.RULE))
    empty = rules_from(spark.createDataFrame([], schemas.RULE))
    frame = spark.createDataFrame(
        [("ls", "shell", False)], "remediation_command string, command_type string, requires_human_approval boolean"
    )
    assert governance.decide(frame, empty).collect()[0].remediation.status == schemas.BLOCKED


def test_counts_add_up(spark):
    rows = [(c, t, False, None) for c, t, _ in DENIED] + [(c, t, False, None) for c, t in MISSED]
    frame = spark.createDataFrame(
        rows,
        "remediation_command string, command_type string, requires_human_approval boolean, "
        "runbook_steps array<string>",
    )
    counts = governance.decision_counts(governance.decide(frame, RULES))
    assert counts.agg(F.sum("commands")).collect()[0][0] == len(rows)


def test_long_rule_table_is_judged_whole(spark):
    rows = [("deny", None, n, rf"\bword{n}\b") for n in range(1, 5001)]
    rows += [("allow", "shell", n, f"verb{n} ") for n in range(1, 301)]
    rules = rules_from(spark.createDataFrame(rows, schemas.RULE))
    commands = ["word5000 now", "word201 word7", "verb300 it", "verb301 it"]
    frame = spark.createDataFrame(
        [(c, "shell", False) for c in commands],
        "remediation_command string, command_type string, requires_human_approval boolean",
    )
    got = {r.remediation_command: r.governance for r in governance.decide(frame, rules).collect()}
    assert got["word5000 now"].matched_denylist_pattern == r"\bword5000\b"
    assert got["word201 word7"].matched_denylist_pattern == r"\bword7\b"
    assert got["verb300 it"].allowlist_verb == "verb300 "
    assert got["verb301 it"].guardrail_triggered and got["verb301 it"].allowlist_verb is None
    found = governance.denied_by_table(frame, rules, spark).collect()
    assert sorted(r.ordinal for r in found) == [7, 5000]


def test_rules_must_compile_in_the_engine(spark):
    named = rules_from(spark.createDataFrame([("deny", None, 1, r"(?P<x>rm)\s")], schemas.RULE))
    frame = spark.createDataFrame(
        [("rm x", "shell", False)], "remediation_command string, command_type string, requires_human_approval boolean"
    )
    assert governance.decide(frame, named).collect()[0].governance.guardrail_triggered
    again = rules_from(spark.createDataFrame([("deny", None, 1, r"(?P<x>r.)\s(?P=x)\b")], schemas.RULE))
    frame = spark.createDataFrame([(c, "shell", False) for c in ("rm rm", "rm rn")], frame.schema)
    assert [r.governance.guardrail_triggered for r in governance.decide(frame, again).collect()] == [True, True]
    assert [r.governance.matched_denylist_pattern is None for r in governance.decide(frame, again).collect()] == [False, True]
    with pytest.raises(ValueError):
        rules_from(spark.createDataFrame([("deny", None, 1, r"(a)?(?(1)b|c)")], schemas.RULE))


def test_rule_texts_are_what_they_should_be():
    """The lists' own digest, so that a slip in either shows."""
    spelt = "\n".join(governance.DENY_PATTERNS) + "\n\n" + "\n".join(
        f"{kind} {prefix}" for kind, prefixes in governance.ALLOWED_PREFIXES.items() for prefix in prefixes
    )
    assert len(governance.DENY_PATTERNS) == 17 and sum(map(len, governance.ALLOWED_PREFIXES.values())) == 27
    assert hashlib.sha256(spelt.encode()).hexdigest() == "9d70cd1d73dd8c704a5137aad9915802017b0fd2bc62cd2bc733dbcfc0bfd567"
    texts = [governance.DENIED, governance.NOT_ALLOWED, reports.ESCALATION, reports.DEFAULT_REASON, answers.UNAVAILABLE]
    texts += list(reports.NO_ANCHOR.values())
    assert hashlib.sha256("\n".join(texts).encode()).hexdigest() == "295ec8582ab89467cd9bf953b1dd35b9d062258df8f6a5e872d938de5e111a80"


@pytest.mark.parametrize("pattern,literals", [
    (r"\brm\s+-rf\b", {"-rf"}),
    (r"\bDROP\s+(TABLE|DATABASE|SCHEMA)\b", {"table", "database", "schema"}),
    (r"(abc)+x?", {"abc"}),
    (r"(abc)*", None),
    (r"a|", None),
    (r"[ab]\d", None),
    (r"(?:foo|(?:ba|bar)z)", {"foo", "ba"}),
    (r"é+x(?=yy)", {"x"}),
    (r"K\b-b", {"k-b"}),
])
def test_literals_that_a_match_needs(pattern, literals):
    assert screening.needed_literals(pattern) == literals


def test_screens_find_what_all_patterns_find():
    rng = random.Random(4)
    parts = ["rm", "\\s+", "-rf", "(a|bc)", "k?", "\\b", "s[xy]", "(?:i0){1,2}", "\u017f", "(?!z)", ".*", "É"]
    words = ["rm ", "-RF", "a", "bc", "K", "\u212a", "\u017fx", "sy", "I0i0", "\u01300", "\u0131", " ", "z", "é", "\x1c"]
    patterns = []
    while len(patterns) < 300:
        pattern = "".join(rng.choices(parts, k=rng.randint(1, 4)))
        patterns.append(pattern)
    screen = screening.Screen(patterns)
    tried = 0
    for _ in range(400):
        text = "".join(rng.choices(words, k=rng.randint(0, 8)))
        hits = [n for n, p in enumerate(patterns) if re.search(p, text, re.IGNORECASE)]
        assert set(hits) <= set(screen.candidates(text)), text
        assert screen.first(text) == (hits[0] + 1 if hits else None)
        tried += len(screen.candidates(text))
    assert tried < 400 * 300 * 0.6


def test_time_hardly_grows_with_the_rules():
    """Patterns tried for a command: a few, of 17 rules or of 5,000."""
    small = screening.Screen(governance.DENY_PATTERNS)
    large = screening.Screen(governance.DENY_PATTERNS + [rf"\bworker-{k}\b" for k in range(4983)])
    texts = [f"systemctl restart worker-{n}" for n in range(300)] + [c for c, *_ in DENIED]
    tried = [sum(len(s.candidates(t)) for t in texts) for s in (small, large)]
    assert tried[1] <= tried[0] + 4 * len(texts)


def test_first_prefix_of_fifty_thousand(spark):
    rows = [("allow", "shell", n + 1, f"run /{n}") for n in range(50_000)] + [("allow", "sql", 1, "run /7"), ("allow", "shell", 60_000, "run")]
    rules = rules_from(spark.createDataFrame(rows, schemas.RULE))
    given = [("run /123 x", "shell"), ("run x", "shell"), ("run /7", "sql"), ("run /8", "sql"), ("ru", "shell"), ("run /1", None), (None, "shell"), ("", "helm")]
    frame = spark.createDataFrame([(n, *g, False) for n, g in enumerate(given)], "n int, remediation_command string, command_type string, requires_human_approval boolean")
    got = {r.n: r.verb for r in governance.judge(frame, rules).collect()}
    want = {}
    for n, (command, kind) in enumerate(given):
        fits = [(o, p) for _, k, o, p in rows if command and k == kind and command.startswith(p)]
        want[n] = min(fits)[1] if fits else None
    assert got == want
