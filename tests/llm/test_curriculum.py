import math
import re
from collections import defaultdict

import pytest
from helpers import documents, sample
from tocsin.llm import curriculum

SCHEMA = "doc_id long, text string, source string, words long, position string, key long"


def table(spark, rows):
    """Documents (doc_id, text, source); extra columns carry names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def wanted(sizes: dict, share=1.5, most=2) -> dict:
    """Targets in plain code: what is above a source's limit is dealt anew, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    full, words = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = words - sum(most * sizes[s] for s in full)
        found = {s: left * weights[s] / sum(weights[r] for r in rest) for s in rest}
        above = {s for s in rest if found[s] > most * sizes[s]}
        if not above:
            return found | {s: most * sizes[s] for s in full}
        full |= above


def test_targets_are_met_and_no_document_is_taken_too_often(spark):
    rows = [(r[0], r[1], r[3]) for r in sample("documents")]
    rows += [(-1, None, "src0"), (-2, "", "src1"), (-3, "a b c", None), (-4, " \n", None), (None, "a b", "src2")] * 2
    found = curriculum.curriculum(table(spark, rows)).collect()
    sizes, taken, passes = defaultdict(int), defaultdict(int), defaultdict(list)
    for doc, text, source in rows:
        sizes[source] += len(re.findall(curriculum.WORD, text or ""))
    for r in found:
        taken[r.source] += r.words
        passes[r.uid].append(r)
        assert len(re.findall(curriculum.WORD, r.text or "")) == r.words
        assert (r.words == 0) == (r.position is None) == (r["pass"] is None) == (r.text is None)
    assert len(passes) == len(rows)
    targets = wanted(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], abs_tol=1e-9)
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= 0.5
    whole = {(r.doc_id, r.text) for r in found if 0 < r.words == r.size}
    assert whole <= {(d, t) for d, t, _ in rows}
    for own in passes.values():
        assert sum(r.words for r in own) <= 2 * own[0].size
        assert [r["pass"] for r in own] in ([None], [0], [0, 1])


def test_rows_come_in_order_of_training_and_sources_follow_their_schedules(spark):
    rows = [(n, "w " * (1 + n % 7), f"s{n % 3}") for n in range(3000)]
    found = curriculum.curriculum(table(spark, rows)).collect()
    times = [r.position for r in found if r.position is not None]
    assert times == sorted(times) and 0 <= times[0] and times[-1] < 1
    by_source = defaultdict(lambda: [0.0, 0.0])
    for r in found:
        if r.position is not None:
            by_source[r.source][r.position >= 0.5] += r.words
    for n, schedule in enumerate(curriculum.SCHEDULES):
        a, b, c = schedule
        first, second = by_source[f"s{n}"]
        assert math.isclose(first / (first + second), (a + b) / (a + 2 * b + c), abs_tol=0.01)


@pytest.mark.parametrize("schedule", [(4.0, 3.0, 2.0), (0.0, 1.0), (1.0, 0.0, 0.0, 2.0), (2.0, 2.0)])
def test_positions_invert_the_integral(spark, schedule):
    total, step = curriculum.weight(schedule), 1 / (len(schedule) - 1)
    areas = [total * n / 200 for n in range(200)]
    frame = spark.createDataFrame([(a,) for a in areas], "area double")
    rows = frame.select("area", curriculum.position(frame.area, schedule).alias("t")).collect()
    for r in rows:
        done = 0.0
        for n, (a, b) in enumerate(zip(schedule, schedule[1:])):
            x = min(max(r.t - n * step, 0), step)
            done += a * x + (b - a) * x * x / (2 * step)
        assert math.isclose(done, r.area, abs_tol=1e-9) and 0 <= r.t < 1


def test_order_does_not_depend_on_the_layout(spark):
    rows = [(n % 40, f"w {n % 50} " * (n % 9), f"s{n % 5}" if n % 7 else None) for n in range(400)]
    one = curriculum.curriculum(table(spark, rows).repartition(1), with_text=False).drop("uid").collect()
    two = curriculum.curriculum(table(spark, rows[::-1]).repartition(7), with_text=False).drop("uid").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_a_hot_source_is_not_one_task(spark):
    rows = [(n, "w", "hot") for n in range(6000)] + [(n, "w", f"s{n % 9}") for n in range(6000, 9000)]
    frame = curriculum.curriculum(table(spark, rows), with_text=False)
    assert frame.where("words > 0").count() == 9000 * 1.5
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 3 and all("bucket" in line or "coarse" in line for line in windows)


def test_no_words_and_an_empty_table(spark):
    found = curriculum.curriculum(table(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.source_size, r.target, r.words, r.position) for r in found] == [(0, 0, 0.0, 0, None)] * 2
    assert curriculum.curriculum(documents(spark, []).selectExpr("*", "'s' AS source")).collect() == []
