"""Shapes on hand-made series."""
import datetime
import math

import pytest

from panelwright.operators import shapes

DAY = datetime.date(2020, 1, 1)


def table(spark, closes, half=0.5, vol=None, symbol="A"):
    rows = [(symbol, DAY + datetime.timedelta(i), c, c + half, c - half, c, float(vol[i]) if vol else 100.0) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, vol double")


def wide(spark, rows, symbol="A"):
    """Rows of (high, low, close, vol)."""
    return spark.createDataFrame([(symbol, DAY + datetime.timedelta(i), c, h, l, c, v) for i, (h, l, c, v) in enumerate(rows)], "symbol string, trade_date date, open double, high double, low double, close double, vol double")


def patterns(d, **kw):
    last = max(shapes.chart_patterns(d, **kw).collect(), key=lambda r: r.trade_date)
    return {p.name: p for p in last.patterns}, last.score


def test_triangles_by_their_lines(spark):
    n = 60
    sym = [(110 - 0.1 * i, 90 + 0.1 * i, 100.0, 100.0) for i in range(n)]
    got, score = patterns(wide(spark, sym))
    assert got["symmetric_triangle"].direction == "neutral" and got["symmetric_triangle"].confidence == 65 and got["symmetric_triangle"].level is None
    up = sym[:-3] + [(107.0, 99.0, 106.5, 300.0), (108.0, 105.0, 107.5, 100.0), (109.0, 106.0, 108.5, 100.0)]
    got, _ = patterns(wide(spark, up))
    p = got["symmetric_triangle"]
    assert (p.direction, p.confidence) == ("bullish", 80) and p.strength == 100  # three rows, body, volume, a low at the line again, more than 2 % above
    rising = [(110.0 + 0.001 * i, 95 + 0.2 * i, 103.0 + 0.1 * i, 100.0) for i in range(n)]
    assert patterns(wide(spark, rising))[0]["ascending_triangle"].confidence == 70
    falling = [(110.0 - 0.2 * i, 90.0, 97.0 - 0.05 * i, 100.0) for i in range(n)]
    assert patterns(wide(spark, falling))[0]["descending_triangle"].direction == "bearish"


def test_box_flag_cup_and_rounding(spark):
    box = [100 + 2 * math.sin(i / 3) for i in range(60)]
    assert "box" in patterns(table(spark, box))[0]
    flag = [100 + i for i in range(31)] + [130 - 0.1 * i for i in range(29)]
    got, _ = patterns(table(spark, flag))
    assert got["bull_flag"].direction == "bullish" and "bear_flag" not in got
    bear = [130 - i for i in range(31)] + [100 + 0.1 * i for i in range(29)]
    assert "bear_flag" in patterns(table(spark, bear))[0]
    cup = [100 - 0.8 * min(i, 57 - i, 25) for i in range(57)] + [101.0, 100.5, 99.5]
    assert "cup_and_handle" in patterns(table(spark, cup))[0]
    bowl = [100 + 0.01 * (i - 30) ** 2 + (3 if i == 59 else 0) for i in range(60)]
    got, _ = patterns(table(spark, bowl))
    assert got["rounding_bottom"].confidence > 70 and "rounding_top" not in got
    assert "rounding_top" in patterns(table(spark, [200 - x for x in bowl]))[0]


def test_double_bottom_with_neckline_and_target(spark):
    w = [110 - i for i in range(11)] + [100 + i for i in range(1, 9)] + [108 - i for i in range(1, 9)] + [100 + i for i in range(1, 8)]
    got, score = patterns(table(spark, w))
    p = got["double_bottom"]
    assert (p.confidence, p.level, p.target) == (75, 108.5, 108.5 + (108.5 - 99.5)) and p.strength == 0
    got, _ = patterns(table(spark, [*w, 109, 110]))
    assert got["double_bottom"].confidence == 85
    got, _ = patterns(table(spark, [200 - x for x in w]))
    assert got["double_top"].direction == "bearish" and got["double_top"].level == 91.5
    far = [110 - i for i in range(11)] + [100 + i for i in range(1, 9)] + [108 - i for i in range(1, 13)] + [96 + i for i in range(1, 8)]
    assert "double_bottom" not in patterns(table(spark, far))[0]  # the lows differ by over 3 %


def test_short_symbols_show_nothing_and_symbols_do_not_mix(spark):
    w = [110 - i for i in range(11)] + [100 + i for i in range(1, 9)] + [108 - i for i in range(1, 9)] + [100 + i for i in range(1, 8)]
    both = table(spark, w[:24]).union(table(spark, w, symbol="B"))
    out = shapes.chart_patterns(both).collect()
    assert all(r.patterns == [] and r.score == 0 for r in out if r.symbol == "A") and any(r.patterns for r in out if r.symbol == "B")
    assert shapes.chart_patterns(both.limit(0)).collect() == []


def test_breaks_by_rows_body_volume_and_test(spark):
    from pyspark.sql import functions as F

    def broke(closes, level, up=True, half=0.5, vol=None):
        d = shapes.framed(table(spark, closes, half, vol)).withColumn("level", F.lit(float(level)))
        return max(shapes.broken(d, "level", "b", up).collect(), key=lambda r: r.trade_date).b

    calm = [100.0] * 25
    b = broke([*calm, 104, 105], 102, vol=[100] * 25 + [200, 100])
    assert (b.rows, b.kind, b.confirmed, b.volume_ratio) == (2, "clean", True, pytest.approx(1.9, abs=0.01)) and b.strength == 20 + 20 + 20 + 15
    assert broke([*calm, 103], 102).kind == "fresh" and broke(calm, 100.2).kind == "wick_only" and broke(calm, 100.2).strength == 10
    assert broke([*calm, 103, 104, 102.2], 102).kind == "with_retest"
    assert broke([*calm, 96, 95], 98, up=False).confirmed and broke(calm, 98, up=False).kind == "none"
    assert broke([100.0] * 4, 99) is None
