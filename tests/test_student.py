"""Tails of Student's t against the finite series for whole degrees of freedom, printed tables and integration."""
import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import student


def series(t, n):
    """Two-sided p by sines and cosines."""
    a = math.atan(abs(t) / math.sqrt(n))
    if n % 2:
        total, term = 0.0, math.cos(a)
        for k in range((n - 1) // 2):
            total += term
            term *= math.cos(a) ** 2 * (2 * k + 2) / (2 * k + 3)
        return 1 - 2 / math.pi * (a + math.sin(a) * total)
    total, term = 0.0, 1.0
    for k in range(n // 2):
        total += term
        term *= math.cos(a) ** 2 * (2 * k + 1) / (2 * k + 2)
    return 1 - math.sin(a) * total


def tails(spark, pairs):
    d = spark.createDataFrame([(i, t, float(n) if n is not None else None) for i, (t, n) in enumerate(pairs)], "i int, t double, n double")
    rows = d.select("i", student.two_sided(F.col("t"), F.col("n")).alias("p"), student.one_sided(F.col("t"), F.col("n")).alias("q")).orderBy("i").collect()
    return [r.p for r in rows], [r.q for r in rows]


def test_equals_the_series_for_2_to_200_degrees(spark):
    pairs = [(t, n) for n in [1, 2, 3, 4, 5, 8, 13, *range(20, 201, 15), 199, 200, 1001, 20000] for t in (0.0, 0.01, -0.7, 1.0, 1.96, -3.3, 12.0)]
    p, q = tails(spark, pairs)
    for (t, n), x, y in zip(pairs, p, q):
        want = series(t, n)
        assert x == pytest.approx(want, abs=1e-9), (t, n)
        assert y == pytest.approx(want / 2 if t > 0 else 1 - want / 2, abs=1e-9)


def test_equals_tables(spark):
    table = [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.086, 20, 0.05), (2.750, 30, 0.01), (1.980, 120, 0.05), (63.657, 1, 0.01)]
    p, _ = tails(spark, [(t, n) for t, n, _ in table])
    assert p == pytest.approx([x for *_, x in table], abs=3e-5)


def test_small_tails_broken_degrees_and_nulls(spark):
    def integral(t, n, steps=200_000):
        """Of the density from |t| on, over u = 1 / x."""
        c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        h = 1 / abs(t) / steps
        return 2 * sum(c * (1 + 1 / (n * u * u)) ** (-(n + 1) / 2) / (u * u) * h for u in ((k + 0.5) * h for k in range(steps)))

    pairs = [(3.1, 7.5), (1.2, 2.25), (25.0, 30.0)]
    p, _ = tails(spark, pairs)
    assert p == pytest.approx([integral(*x) for x in pairs], rel=1e-6)
    assert tails(spark, [(None, 5), (1.0, None), (1.0, 0)])[0] == [None, None, None]
