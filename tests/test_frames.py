"""Resonance of time frames: its table of scores, and that no bar sees an unfinished higher one."""
import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from panelwright.operators import resonance as R

DAY = dt.date(2020, 1, 6)


def score(high, middle, base):
    """The table read case by case."""
    if min(high, middle, base) >= 1:
        return 75 + 4 * (high + middle + base - 3)
    if max(high, middle, base) <= -1:
        return 25 - 4 * (-high - middle - base - 3)
    if high > 0:
        return {2: (70, 60, 50), 1: (65, 55, 45)}[high][0 if middle >= 1 else 1 if middle == 0 else 2]
    if high == -2:
        return 22 if base >= 1 else 18
    if high == -1:
        return 32 if base >= 1 else 28 if middle <= -1 else 38
    if middle:
        return {2: 65, 1: 58, -1: 42, -2: 32}[middle]
    return 53 if base >= 1 else 47 if base <= -1 else 50


def test_every_combination_of_states(spark):
    rows = list(itertools.product(range(-2, 3), repeat=3))
    d = spark.createDataFrame(rows, "high int, middle int, base int").withColumn("score", R.resonance(F.col("high"), F.col("middle"), F.col("base")))
    got = {(r.high, r.middle, r.base): r.score for r in d.collect()}
    assert got == {x: max(10, min(90, score(*x))) for x in rows} and got[(2, 2, 2)] == 87 and got[(-2, -2, -2)] == 13


def bars(spark, n, seed=1):
    r, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        before, price = price, price * (1 + r.gauss(0.001 if (i // 80) % 2 else -0.001, 0.02))
        rows.append(("A", DAY + dt.timedelta(7 * i), before, price))
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double")


def test_a_bar_of_a_higher_frame_counts_once_it_is_finished(spark):
    d = bars(spark, 30)
    done = {r.trade_date: r for r in R.finished(d, "month").collect()}
    rows = sorted((r.trade_date, r.open, r.close) for r in d.collect())
    for first, r in done.items():
        before = (first - dt.timedelta(1)).replace(day=1)
        own = [x for x in rows if before <= x[0] < first]
        assert abs(r.body - 100 * (own[-1][2] / own[0][1] - 1)) < 1e-6 and 0 <= r.bulls <= 3


def test_states_do_not_look_ahead(spark):
    whole = {r.trade_date: tuple(r) for r in R.states(bars(spark, 300)).collect()}
    for n in (130, 219):
        cut = {r.trade_date: tuple(r) for r in R.states(bars(spark, n)).collect()}
        assert cut == {k: v for k, v in whole.items() if k in cut} and len(cut) == n
    assert {v[2] for v in whole.values()} >= {-2, -1, 0, 1, 2}


def test_a_crash_of_the_high_frame_and_three_rising_months_count(spark):
    rows = [("A", DAY + dt.timedelta(7 * i), 100.0, 100.0 if i < 30 else 90.0) for i in range(60)]
    d = spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double")
    got = {r.trade_date: r.high for r in R.states(d).collect()}
    assert got[rows[29][1]] == 0 and min(got.values()) == -1
    up = [("A", DAY + dt.timedelta(7 * i), 100.0 + i % 5 * 0.001, 100.01 + i % 5 * 0.001) for i in range(40)]
    last = max(R.states(spark.createDataFrame(up, "symbol string, trade_date date, open double, close double")).collect(), key=lambda r: r.trade_date)
    assert last.middle == 1
