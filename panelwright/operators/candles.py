"""Thirty-five candle patterns of one to five bars, all of one pass, weighed by where the price stands.

Conditions are text over the last five bars (o, h, l, c and their lags o1 to c4), bodies b, their sizes a and ranges r. One window gives
all lags, so a symbol's bars are sorted once and conditions stay in generated code.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import back, lag, over

LAGS = {f"{x}{k or ''}": lag(c, k) if k else c for x, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for k in range(5)}
COUNTS = {"n": f"count(*) {over(back(5))}", "top20": f"max(close) {over(back(20))}", "low20": f"min(close) {over(back(20))}"}
PARTS = {f"{x}{k or ''}": text.format(k=k or "") for k in range(5) for x, text in (("b", "c{k} - o{k}"), ("a", "abs(c{k} - o{k})"), ("r", "(CASE WHEN h{k} = l{k} THEN 1e-8 ELSE h{k} - l{k} END)"))} | {
    # The sign of the least-squares slope of the last five closes, or of those that are there from three on.
    "slope": "round(CASE WHEN n >= 5 THEN 2 * c + c1 - c3 - 2 * c4 WHEN n = 4 THEN 3 * c + c1 - c2 - 3 * c3 WHEN n = 3 THEN c - c2 ELSE 0.0 END, 9)",
    "top": "h - greatest(o, c)", "tail": "least(o, c) - l", "place": "(CASE WHEN top20 > low20 THEN 100 * (close - low20) / (top20 - low20) ELSE 50.0 END)",
}

_LONG_TAIL, _LONG_TOP = "tail >= 2 * greatest(a, 0.04 * r) AND top < 0.15 * r", "top >= 2 * greatest(a, 0.04 * r) AND tail < 0.15 * r"
_ENGULF_UP, _ENGULF_DOWN = "b1 < -0.25 * r1 AND b > 0 AND o <= c1 AND c >= o1", "b1 > 0.25 * r1 AND b < 0 AND o >= c1 AND c <= o1"
_SMALL = lambda sign: " AND ".join(f"{sign} * b{k} > 0 AND a{k} < 0.4 * a4 AND l{k} >= l4 AND h{k} <= h4" for k in (1, 2, 3))
#: Name, direction, confidence, and the condition.
PATTERNS = (
    ("hammer", "bullish", 74, f"{_LONG_TAIL} AND slope < 0"), ("hanging_man", "bearish", 66, f"{_LONG_TAIL} AND slope > 0"), ("shooting_star", "bearish", 74, f"{_LONG_TOP} AND slope > 0"), ("inverted_hammer", "bullish", 61, f"{_LONG_TOP} AND slope < 0"),
    ("doji", "neutral", 50, "a < 0.1 * r"), ("long_rise", "bullish", 67, "b > 0.6 * r"), ("long_fall", "bearish", 67, "b < -0.6 * r"),
    ("bullish_engulfing", "bullish", 79, _ENGULF_UP), ("bearish_engulfing", "bearish", 79, _ENGULF_DOWN),
    ("bullish_harami", "bullish", 63, "b1 < -0.35 * r1 AND b > 0 AND o > c1 AND c < o1 AND a < 0.55 * a1"), ("bearish_harami", "bearish", 63, "b1 > 0.35 * r1 AND b < 0 AND o < c1 AND c > o1 AND a < 0.55 * a1"),
    ("piercing", "bullish", 73, "b1 < -0.3 * r1 AND b > 0 AND o < l1 AND c > (o1 + c1) / 2"), ("dark_cloud", "bearish", 73, "b1 > 0.3 * r1 AND b < 0 AND o > h1 AND c < (o1 + c1) / 2"),
    ("flat_top", "bearish", 65, "slope > 0 AND abs(h - h1) < 0.003 * h1"), ("flat_bottom", "bullish", 65, "slope < 0 AND abs(l - l1) < 0.003 * l1"),
    ("bullish_counter", "bullish", 68, "b1 < 0 AND b > 0 AND o < l1 AND abs(c - c1) < 0.003 * abs(c1)"), ("bearish_counter", "bearish", 68, "b1 > 0 AND b < 0 AND o > h1 AND abs(c - c1) < 0.003 * abs(c1)"),
    ("gap_up_rise", "bullish", 72, "o > h1 AND b > 0"), ("gap_down_fall", "bearish", 72, "o < l1 AND b < 0"),
    ("morning_star", "bullish", 83, "b2 < -0.4 * r2 AND a1 < 0.3 * r1 AND b > 0.4 * r AND c > (o2 + c2) / 2"), ("evening_star", "bearish", 83, "b2 > 0.4 * r2 AND a1 < 0.3 * r1 AND b < -0.4 * r AND c < (o2 + c2) / 2"),
    ("three_soldiers", "bullish", 84, "b2 > 0.3 * r2 AND b1 > 0.3 * r1 AND b > 0.3 * r AND c > c1 AND c1 > c2 AND o1 > o2 AND o > o1"), ("three_crows", "bearish", 84, "b2 < -0.3 * r2 AND b1 < -0.3 * r1 AND b < -0.3 * r AND c < c1 AND c1 < c2 AND o1 < o2 AND o < o1"),
    ("fall_between_rises", "bullish", 64, "b2 > 0 AND b1 < 0 AND b > 0 AND c > c2"), ("rise_between_falls", "bearish", 64, "b2 < 0 AND b1 > 0 AND b < 0 AND c < c2"),
    ("three_inside_up", "bullish", 76, "b2 < -0.35 * r2 AND b1 > 0 AND o1 > c2 AND c1 < o2 AND a1 < 0.55 * a2 AND b > 0 AND c > o2"), ("three_inside_down", "bearish", 76, "b2 > 0.35 * r2 AND b1 < 0 AND o1 < c2 AND c1 > o2 AND a1 < 0.55 * a2 AND b < 0 AND c < o2"),
    ("three_outside_up", "bullish", 78, "b2 < -0.25 * r2 AND b1 > 0 AND o1 <= c2 AND c1 >= o2 AND b > 0 AND c > c1"), ("three_outside_down", "bearish", 78, "b2 > 0.25 * r2 AND b1 < 0 AND o1 >= c2 AND c1 <= o2 AND b < 0 AND c < c1"),
    ("small_double_bottom", "bullish", 78, "n >= 5 AND abs(least(l, l1) - least(l3, l4)) < 0.025 * abs(least(l3, l4)) AND greatest(h1, h2, h3) > 1.025 * least(l3, l4) AND b > 0 AND c > 0.97 * greatest(h1, h2, h3)"),
    ("small_double_top", "bearish", 78, "n >= 5 AND abs(greatest(h, h1) - greatest(h3, h4)) < 0.025 * abs(greatest(h3, h4)) AND least(l1, l2, l3) < 0.975 * greatest(h3, h4) AND b < 0 AND c < 1.03 * least(l1, l2, l3)"),
    ("small_head_bottom", "bullish", 81, "n >= 5 AND least(l1, l2, l3) < 0.985 * least(l3, l4) AND least(l1, l2, l3) < 0.985 * least(l, l1) AND abs(least(l3, l4) - least(l, l1)) < 0.04 * least(l3, l4) AND c > greatest(h1, h3)"),
    ("small_head_top", "bearish", 81, "n >= 5 AND greatest(h1, h2, h3) > 1.015 * greatest(h3, h4) AND greatest(h1, h2, h3) > 1.015 * greatest(h, h1) AND abs(greatest(h3, h4) - greatest(h, h1)) < 0.04 * greatest(h3, h4) AND c < least(l1, l3)"),
    ("rising_three", "bullish", 80, f"b4 > 0.5 * r4 AND {_SMALL(-1)} AND b > 0.5 * r AND c > h4"), ("falling_three", "bearish", 80, f"b4 < -0.5 * r4 AND {_SMALL(1)} AND b < -0.5 * r AND c < l4"),
)


def weighed(direction: str, confidence: int) -> str:
    """Confidence of a pattern: more where its direction turns the price back from an end of the last 20 closes, less where the price is at that end already."""
    near, far = ("place < 30", "place > 70") if direction == "bullish" else ("place > 70", "place < 30")
    return str(confidence) if direction == "neutral" else f"greatest(30, least(95, {confidence} + (CASE WHEN {near} THEN 8 WHEN {far} THEN -10 ELSE 0 END)))"


def candle_patterns(bars: DataFrame) -> DataFrame:
    """(symbol, trade_date, place, patterns): structs of name, direction and confidence of all patterns that end with a bar, and where its close lies among the last 20, in percent.

    Bars that a pattern lacks make it absent. A bar without a pattern has none; the shapes that need a trend have none on a level one.
    """
    d = bars.selectExpr("symbol", "trade_date", "close", *(f"{x} AS {c}" for c, x in (LAGS | COUNTS).items()))
    d = d.selectExpr("*", *(f"{_doubles(x)} AS {c}" for c, x in PARTS.items()))
    found = [F.expr(f"CASE WHEN {_doubles(cond)} THEN named_struct('name', '{name}', 'direction', '{way}', 'confidence', {weighed(way, sure)}) END") for name, way, sure, cond in PATTERNS]
    return d.select("symbol", "trade_date", "place", F.filter(F.array(*found), lambda p: p.isNotNull()).alias("patterns"))


def _doubles(x: str) -> str:
    from .spec import doubles

    return doubles(x)


def sql(source: str = "bars") -> str:
    """CTEs for a row (symbol, trade_date, place, name, direction, confidence) of each pattern in relation `cp`, from the same text: that the formulas are right is for the tests."""
    cols = lambda m: ", ".join(f"{x} AS {c}" for c, x in m.items())
    rows = " UNION ALL ".join(f"SELECT symbol, trade_date, place, '{name}' AS name, '{way}' AS direction, {weighed(way, sure)} AS confidence FROM c1_ WHERE {cond}" for name, way, sure, cond in PATTERNS)
    return f"c0_ AS (SELECT symbol, trade_date, close, {cols(LAGS | COUNTS)} FROM {source}), c1_ AS (SELECT *, {cols(PARTS)} FROM c0_), cp AS ({rows})"
