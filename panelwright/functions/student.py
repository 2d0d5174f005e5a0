"""Tails of Student's t as column expressions: the regularised incomplete beta function by its continued fraction."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction; it has settled to 1e-12 long before for up to some 100,000 degrees of freedom.
STEPS = 400


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series eight steps up, where its error is under 1e-14."""
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    shift = F.log(z)
    for k in range(1, 8):
        shift = shift + F.log(z + k)
    return (y - 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2 + series - shift


def _fraction(v: Column) -> Column:
    """The continued fraction of struct v (a, b, x): each step adds one coefficient to numerator and denominator."""
    a, b, x = v["a"], v["b"], v["x"]

    def coefficient(j: Column) -> Column:
        m = F.floor(j / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    def kept(y: Column) -> Column:
        return F.when(F.abs(y) < 1e-300, 1e-300).otherwise(y)

    def step(s: Column, j: Column) -> Column:
        k = coefficient(j)
        d, c = 1 / kept(1 + k * s["d"]), kept(1 + k / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    # So that the first step gives c = 1 and h = d.
    start = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) with rest = 1 - x, each given so that none loses digits; from the side where the fraction settles fast."""
    left = x < (a + 1) / (a + b + 2)
    pick = lambda p, q: F.when(left, p).otherwise(q)
    v = F.struct(pick(a, b).alias("a"), pick(b, a).alias("b"), pick(x, rest).alias("x"))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    part = front * _fraction(v) / v["a"]
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.when(left, part).otherwise(1 - part))


def two_sided(t: Column, freedom: Column) -> Column:
    """The chance of a t as far from 0; null without t or under one degree of freedom."""
    t, n = t.cast("double"), freedom.cast("double")
    return F.when(t.isNotNull() & (n >= 1), incomplete_beta(n / (n + t * t), t * t / (n + t * t), n / 2, F.lit(0.5)))


def one_sided(t: Column, freedom: Column) -> Column:
    """The chance of a t as high."""
    p = two_sided(t, freedom)
    return F.when(t > 0, p / 2).otherwise(1 - p / 2)
