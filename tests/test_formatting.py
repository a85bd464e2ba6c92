"""Text rendering agrees with Python's format specs on many values."""

import random

from pyspark.sql import functions as F

from tillroll.functions.numbers import round_like_python
from tillroll.operators.insights import render


def _values(n=3000):
    rng = random.Random(7)
    out = [0.0, 0.5, 1.5, 2.5, 2.675, 0.125, 0.375, 12.35, 1234567.675, 999.995, 1e15 + 0.25, 1e14 + 0.996, 3.0127084015728346e17, -1e15 - 0.75]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            out.append(round(rng.uniform(0, 1e7), 3))  # decimal-looking values, many near ties
        elif kind < 0.6:
            out.append(rng.randint(0, 10**6) / 8)  # exact binary ties
        elif kind < 0.8:
            out.append(rng.uniform(-1e9, 1e9))
        else:
            out.append(rng.choice([1, -1]) * rng.uniform(1e13, 9e18))  # beyond 17 significant digits
    return out


def test_render_matches_python_format(spark):
    values = _values()
    df = spark.createDataFrame([(float(v), int(abs(v))) for v in values], "x double, n bigint")
    text = render("{x:,.2f}|{x:.1f}|{x:.2f}|{n:,}|{n}", {"x": F.col("x"), "n": F.col("n")})
    got = [r[0] for r in df.select(text).collect()]
    want = [f"{v:,.2f}|{v:.1f}|{v:.2f}|{int(abs(v)):,}|{int(abs(v))}" for v in values]
    assert got == want


def test_round_like_python(spark):
    values = _values(1000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(round_like_python(F.col("x"), 2)).collect()]
    assert got == [round(v, 2) for v in values]
