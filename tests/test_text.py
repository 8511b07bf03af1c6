import json
import random

from pyspark.sql import functions as F

from tocsin.functions.rounding import round_cents, round_whole
from tocsin.functions.text import SPACES, json_quote, split_lines, strip

PROBES = [
    "", "\n", "a", "a\n", "\na", "a\n\n", "a\r\nb", "a\rb\n", "a\r\n\r\nb\r", "a\x0bb\x0cc\x1cd\x1de\x1ef",
    "a\x85b c d", "\x1f a \x1f", "a\n\r\nb", "　x ", " \t x y \x85", "x​y", "\r\n",
]


def test_split_lines_equals_python(spark):
    frame = spark.createDataFrame([(p,) for p in PROBES], "t string")
    for text, lines in frame.select("t", split_lines(F.col("t"))).collect():
        assert lines == text.splitlines(), repr(text)


def test_strip_equals_python(spark):
    probes = PROBES + [f"{s}in{s}side{s}" for s in SPACES]
    frame = spark.createDataFrame([(p,) for p in probes], "t string")
    for text, stripped in frame.select("t", strip(F.col("t"))).collect():
        assert stripped == text.strip(), repr(text)


def test_json_quote_equals_python(spark):
    probes = PROBES + ['say "hi" \\ /', "café", "\U0001f600 ok", "\x7f\x01\x08\x0c", "plain name-1"]
    frame = spark.createDataFrame([(p,) for p in probes], "t string")
    for text, quoted in frame.select("t", json_quote(F.col("t"))).collect():
        assert quoted == json.dumps(text), repr(text)


def test_round_equals_python(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 2.675, 1.005, 0.015, 1.115, -0.125, -2.675, 0.0, 1e15 + 0.5, 342.905, 18.215]
    values += [rng.uniform(-1000, 1000) for _ in range(500)]
    values += [n / 1000 for n in range(5, 3000, 10)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    rows = frame.select("x", round_cents(F.col("x")), round_whole(F.col("x"))).collect()
    for x, cents, whole in rows:
        assert cents == round(x, 2), x
        assert whole == round(x), x
