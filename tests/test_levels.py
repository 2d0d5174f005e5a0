"""Levels, their clusters, and divergences between turning points, on hand-made bars."""
import datetime as dt
import math

import pytest

from panelwright.operators import levels, shapes

DAY = dt.date(2024, 1, 1)


def table(spark, rows, symbol="A"):
    """Rows of (high, low, close, vol)."""
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(i), c, h, l, c, v) for i, (h, l, c, v) in enumerate(rows)], "symbol string, trade_date date, open double, high double, low double, close double, vol double")


def last(d):
    day = max(r.trade_date for r in d)
    return [r for r in d if r.trade_date == day]


def test_candidates_of_every_source(spark):
    rows = [(103.4, 102.6, 103.0, 10.0)] * 70
    rows[20] = (109.0, 102.6, 103.0, 10.0)  # a swing high
    rows[30] = (103.4, 97.0, 103.0, 10.0)  # a swing low
    rows[40:44] = [(106.2, 105.9, 106.0, 500.0)] * 4  # dense volume, gaps on both sides
    got = {(r.side, r.label, r.price) for r in last(levels.candidates(table(spark, rows)).collect())}
    assert {("resistance", "swing_high", 109.0), ("support", "swing_low", 97.0), ("support", "round", 100.0), ("resistance", "gap", 105.9)} <= got
    assert ("support", "gap", 103.4) not in got  # the price is back under it
    assert any(s == "resistance" and l == "volume" and 105.7 <= p <= 106.3 for s, l, p in got)
    mean = sum(r[2] for r in rows[-60:]) / 60
    assert ("resistance", "mean", round(mean, 2)) in got
    assert levels.candidates(table(spark, rows[:29])).collect() == []


def test_clusters_by_gaps_and_the_nearest_first(spark):
    found = spark.createDataFrame([("A", DAY, 100.0, s, l, p) for s, l, p in [("support", "swing_low", 98.0), ("support", "gap", 98.15), ("support", "mean", 98.3), ("support", "round", 90.0), ("resistance", "gap", 101.0), ("resistance", "gap", 101.3)]], "symbol string, trade_date date, now double, side string, label string, price double")
    got = {(r.side, r.rank): r for r in levels.clustered(found).collect()}
    one = got[("support", 1)]
    assert (one.price, one.low, one.high, one.strength, one.labels) == (pytest.approx(98.15), 98.0, 98.3, 3, "gap,mean,swing_low")
    assert got[("support", 2)].price == 90 and got[("resistance", 1)].strength == 1 and got[("resistance", 2)].price == 101.3
    at = levels.position(levels.clustered(found)).first()
    assert (at.support, at.resistance, at.position, at.score, at.support_strength) == (pytest.approx(98.15), 101.0, "middle", 0, 3)
    only = levels.position(levels.clustered(found.where("side = 'support'"))).first()
    assert (only.score, only.position, only.resistance) == (10, "middle", None)


def inputs(spark, highs, difs, rsis, mirrored=False):
    rows = [("A", DAY + dt.timedelta(i), float(i), *((-l, -h) if mirrored else (h, l)), -d if mirrored else d, 100 - r if mirrored else r) for i, ((h, l), d, r) in enumerate(zip(highs, difs, rsis))]
    return spark.createDataFrame(rows, "symbol string, trade_date date, i double, high double, low double, dif double, rsi double")


def two_tops(second, dif, rsi):
    price = [100.0 + 5 * max(0, 1 - abs(i - 40) / 6) + (second - 100) * max(0, 1 - abs(i - 60) / 6) for i in range(80)]
    return [(p, p - 50 - 0.01 * i) for i, p in enumerate(price)], [2.0 if i < 50 else dif for i in range(80)], [70.0 if i < 50 else rsi for i in range(80)]


def test_divergences_of_both_indicators_and_sides(spark):
    at = lambda d: {(r.trade_date - DAY).days: r for r in shapes.divergences(d).collect()}
    got = at(inputs(spark, *two_tops(107, 1.0, 60.0)))
    r = got[63]
    assert (r.macd_top, r.rsi_top, r.macd_magnitude, r.rsi_magnitude, r.bars_ago, r.score) == (True, True, 0.5, 0.4, 3, -(15 + 7) - (12 + 5) - 15)
    assert got[70].bars_ago == 10 and not got[50].macd_top
    up = at(inputs(spark, *two_tops(107, 1.0, 60.0), mirrored=True))[63]
    assert (up.macd_bottom, up.rsi_bottom, up.score) == (True, True, 54)
    assert not at(inputs(spark, *two_tops(104, 1.0, 60.0)))[66].macd_top  # no higher top
    small = at(inputs(spark, *two_tops(107, 3.0, 68.5)))[66]
    assert not small.macd_top and not small.rsi_top and small.bars_ago is None and small.score == 0


def test_turns_are_those_known_at_each_row(spark):
    w, n = 3, 120
    highs = [100 + 5 * math.sin(i / 4) + 3 * math.sin(i * 1.7) for i in range(n)]
    d = inputs(spark, [(h, h - 1) for h in highs], [0.0] * n, [50.0] * n)
    got = {int(r.i): [int(s.i) for s in r.t] for r in shapes.last_two_turns(d, "high", "t", 1, w, 60).collect()}
    for i in range(n):
        known = [p for p in range(max(w, i - 60 + w + 1), i + 1) if all(highs[p] >= highs[q] for q in range(p - w, min(p + w, i) + 1))]
        assert got[i] == known[-2:], i
