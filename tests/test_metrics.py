import random

import pytest
from pyspark.sql import functions as F

from tocsin.operators import metrics

SCHEMA = "service string, status_code int, wall_ms double, prompt_tokens long"


def nearest_rank(values, p):
    values = sorted(values)
    return values[min(len(values) - 1, int(len(values) * p))] if values else 0.0


def made(seed):
    rng = random.Random(seed)
    rows = []
    for n in range(3000):
        service = "hot" if n % 3 else rng.choice("abc")
        value = rng.choice([rng.lognormvariate(3, 2), 17.0, float(rng.randint(0, 5)), 1e9 * rng.random()])
        rows.append((service, 200 if rng.random() < 0.9 else 500, value, rng.choice([None, 5, 10])))
    rows += [("down", 503, 9.0, None), ("single", 200, 4.5, 1), ("same", 200, 7.0, None), ("same", 200, 7.0, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_equal_brute_force(spark, seed):
    rows = made(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.service: r for r in metrics.percentiles(frame, ["service"]).collect()}
    assert set(got) == {r[0] for r in rows}
    for service, row in got.items():
        values = [r[2] for r in rows if r[0] == service and r[1] == 200]
        assert row.succeeded == len(values)
        for name, p in metrics.PERCENTILES.items():
            assert row[name] == nearest_rank(values, p), (service, name)
    total = metrics.percentiles(frame).collect()[0]
    for name, p in metrics.PERCENTILES.items():
        assert total[name] == nearest_rank([r[2] for r in rows if r[1] == 200], p)


HARD = {
    "one value in 99 %": [7.25] * 990 + [float(n) for n in range(10)],
    "neighbours": [1.0 + n * 2.0**-52 for n in range(700)],
    "infinities": [float("inf")] * 30 + [float("-inf")] * 40 + [1e308, -1e308, 5e-324, -5e-324] * 10,
    "zeros": [0.0, -0.0] * 50 + [-1.0],
    "outliers": [1.0 + n / 1000 for n in range(500)] + [1e300, -1e300],
    "nothing": [],
}


def test_percentiles_of_hard_groups(spark):
    rows = [(name, 200, x, None) for name, values in HARD.items() for x in values]
    rows += [(name, 500, 3.0, None) for name in HARD] + [(name, 200, None, None) for name in HARD]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    shares = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.service: r for r in metrics.percentiles(frame, ["service"], shares=shares).collect()}
    for name, values in HARD.items():
        assert got[name].succeeded == len(values)
        assert [got[name][s] for s in shares] == [nearest_rank(values, p) for p in shares.values()], name


def test_order_keys_keep_the_order(spark):
    rng = random.Random(9)
    values = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-320, 300) for _ in range(500)]
    values += [0.0, -0.0, float("inf"), float("-inf"), 5e-324, float("nan")]
    frame = metrics.with_order_key(spark.createDataFrame([(v,) for v in values], "v double"), "v", "k")
    rows = frame.select("v", "k", metrics.keyed_value(F.col("k")).alias("back")).orderBy("k").collect()
    assert rows[-1].v != rows[-1].v
    assert [r.v for r in rows[:-1]] == sorted(v for v in values if v == v) == [r.back for r in rows[:-1]]


def test_no_task_ranks_values(spark):
    """What is shuffled are counts: a group of one hundred thousand distinct values sends few rows."""
    rows = spark.range(100_000, numPartitions=4).selectExpr("'hot' AS service", "200 AS status_code", "id / 7 AS wall_ms", "0L AS t")
    plan = metrics.percentiles(rows, ["service"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("_key" in line or "wall_ms" in line for line in windows)
    row = metrics.percentiles(rows, ["service"]).first()
    assert (row.p50, row.p99) == (50_000 / 7, 99_000 / 7)


def test_twenty_rows_pick_the_last_for_p95(spark):
    frame = spark.createDataFrame([("a", 200, float(n), 1960) for n in range(20)], SCHEMA)
    row = metrics.percentiles(frame).collect()[0]
    assert (row.p50, row.p95, row.p99) == (10.0, 19.0, 19.0)


def test_no_successes(spark):
    frame = spark.createDataFrame([("a", 500, 3.0, None)], SCHEMA)
    row = metrics.percentiles(frame).collect()[0]
    assert (row.succeeded, row.p50, row.p95, row.p99) == (0, 0.0, 0.0, 0.0)
    means = metrics.token_means(frame).collect()[0]
    assert (means.mean_tokens, means.mean_tokens_rounded, means.max_tokens) == (0.0, 0, 0)


def test_counts_means_and_verdicts(spark):
    rows = [("a", 200, 999.0, 2999), ("a", 200, 1.0, 2), ("a", 500, 5000.0, None), ("b", 200, 1000.0, 3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    counts = {r.service: (r.total, r.succeeded, r.failed) for r in metrics.request_counts(frame, ["service"]).collect()}
    assert counts == {"a": (3, 2, 1), "b": (1, 1, 0)}
    verdicts = {r.service: r for r in metrics.verdicts(frame, ["service"]).collect()}
    assert verdicts["a"].p95_under_limit and verdicts["a"].tokens_bounded
    assert not verdicts["b"].p95_under_limit and not verdicts["b"].tokens_bounded
    assert verdicts["a"].mean_tokens == 1500.5 and verdicts["a"].mean_tokens_rounded == 1500


def test_extraction(spark):
    body = '{"timing_ms": {"total": 12.5}, "token_usage": {"prompt_tokens": 7}}'
    frame = spark.createDataFrame(
        [(200, body), (500, body), (200, "{}"), (200, '{"timing_ms": {}}')], "status_code int, body string"
    )
    got = metrics.extract_metrics(frame).select("server_total_ms", "prompt_tokens").collect()
    assert [tuple(r) for r in got] == [(12.5, 7), (None, None), (None, None), (None, None)]
