"""Registered queries of shapes: chart patterns, each with SQL of its own."""
from __future__ import annotations

from pyspark.sql import functions as F

from .operators import candles, levels, shapes, zones
from .panel_queries import W_, query, t


def _break(level: str, up: bool) -> str:
    """Rows of (id, level) joined to the last 20 rows of the frame, as columns rows, strength, confirmed by id."""
    past, run = (">", "<=") if up else ("<", ">=")
    body = f"least(bc, coalesce(pc, bc)) < {level} AND {level} < bc" if up else f"bc < {level} AND {level} < greatest(bc, coalesce(pc, bc))"
    test = f"x.low <= {level} * 1.01" if up else f"x.high >= {level} * 0.99"
    far = f"cl > {level} * 1.02" if up else f"cl < {level} * 0.98"
    wick = f"hl > {level} AND {level} > cl" if up else f"ll < {level} AND {level} < cl"
    return f"""
 SELECT symbol, i, rows, CASE WHEN rows = 0 THEN CASE WHEN {wick} THEN 10 ELSE 0 END ELSE least(100, least(30, rows * 10) + CASE WHEN {body} THEN 20 ELSE 0 END + CASE WHEN usual > 0 AND round(bv / usual + 3e-9, 2) >= 1.3 THEN 20 ELSE 0 END + CASE WHEN again THEN 15 ELSE 0 END + CASE WHEN {far} THEN 15 ELSE 0 END) END AS strength, rows >= 2 AS firm
 FROM (SELECT r.*, y.close AS bc, z.close AS pc, y.vol AS bv, rows >= 3 AND EXISTS (SELECT 1 FROM n x WHERE x.symbol = r.symbol AND x.i BETWEEN r.i - rows + 1 AND r.i AND {test}) AS again
  FROM (SELECT l.symbol, l.i, l.{level}, arg_max(x.close, x.i) AS cl, arg_max(x.high, x.i) AS hl, arg_max(x.low, x.i) AS ll, avg(CASE WHEN x.i < l.i THEN x.vol END) AS usual, l.i - coalesce(max(CASE WHEN x.close {run} l.{level} THEN x.i END), l.i - count(*)) AS rows
   FROM lv l JOIN n x ON x.symbol = l.symbol AND x.i BETWEEN greatest(l.i - 19, 1) AND l.i WHERE l.{level} IS NOT NULL GROUP BY l.symbol, l.i, l.{level}) r
  LEFT JOIN n y ON y.symbol = r.symbol AND y.i = r.i - rows + 1 AND rows > 0 LEFT JOIN n z ON z.symbol = r.symbol AND z.i = r.i - rows AND rows BETWEEN 1 AND 19)"""


def _twins(bottom: bool) -> str:
    y, own, other, agg, most = ("low", "least", "high", "max", ">") if bottom else ("high", "greatest", "low", "min", "<")
    near = "min" if bottom else "max"
    return f"""
 SELECT symbol, i, arg_min(e, row(i1, i2)) AS e, arg_min(neck, row(i1, i2)) AS neck FROM (
  SELECT f.symbol, f.i, a.i AS i1, b.i AS i2, {own}(a.{y}, b.{y}) AS e, f.now, (SELECT {agg}(x.{other}) FROM n x WHERE x.symbol = f.symbol AND x.i BETWEEN a.i AND b.i) AS neck
  FROM f JOIN pv_{y} a ON a.symbol = f.symbol AND a.i BETWEEN f.i - f.k + 6 AND f.i - 5 JOIN pv_{y} b ON b.symbol = f.symbol AND b.i BETWEEN a.i + 10 AND f.i - 5
  WHERE f.k >= 25 AND abs(a.{y} - b.{y}) / {own}(a.{y}, b.{y}) <= 0.03)
 WHERE now {most} e AND neck {most} e GROUP BY symbol, i""".replace("NEAR", near)


def _turns(y: str, agg: str) -> str:
    f = f"OVER ({W_} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    return f"pv_{y} AS (SELECT symbol, i, {y} FROM (SELECT *, {agg}({y}) {f} AS e, count(*) {f} AS cnt FROM n) WHERE {y} = e AND cnt = 11)"


_MID = "(f.i - (f.k - 1) / 2.0)"
_PATTERNS = f"""n AS (SELECT *, CAST(row_number() OVER ({W_}) AS INTEGER) AS i FROM bars),
f AS (SELECT a.symbol, a.trade_date, a.i, CAST(count(*) AS INTEGER) AS k, any_value(a.close) AS now, avg(b.close) AS m, max(b.high) AS hi, min(b.low) AS lo, CASE WHEN count(*) > 1 THEN regr_slope(b.high, b.i) END AS hs, CASE WHEN count(*) > 1 THEN regr_slope(b.low, b.i) END AS ls, CASE WHEN count(*) > 1 THEN regr_slope(b.close, b.i) END AS cs, avg(b.high) AS hm, avg(b.low) AS lm, var_pop(b.close) AS vp, arg_min(b.close, b.i) AS c0
 FROM n a JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 59 AND a.i GROUP BY a.symbol, a.trade_date, a.i),
q AS (SELECT f.symbol, f.i, sum((power(b.i - {_MID}, 2) - (f.k * f.k - 1) / 12.0) * b.close) / nullif(sum(power(power(b.i - {_MID}, 2) - (f.k * f.k - 1) / 12.0, 2)), 0) AS bend, avg(power(power(b.i - {_MID}, 2) - (f.k * f.k - 1) / 12.0, 2)) AS z2 FROM f JOIN n b ON b.symbol = f.symbol AND b.i BETWEEN f.i - 59 AND f.i GROUP BY f.symbol, f.i),
p AS (SELECT f.symbol, f.i, max(CASE WHEN b.i > f.i - f.k // 2 THEN b.high END) AS upper, min(CASE WHEN b.i > f.i - f.k // 2 THEN b.low END) AS lower, max(CASE WHEN b.i = f.i - f.k + 1 + f.k // 2 THEN b.close END) AS mid, min(CASE WHEN b.i - (f.i - f.k + 1) BETWEEN f.k // 3 AND 2 * (f.k // 3) - 1 THEN b.close END) AS trough, max(CASE WHEN b.i > f.i - f.k // 10 THEN b.close END) AS handle FROM f JOIN n b ON b.symbol = f.symbol AND b.i BETWEEN f.i - f.k + 1 AND f.i GROUP BY f.symbol, f.i),
s AS (SELECT f.symbol, f.i, CASE WHEN count(*) > 1 THEN regr_slope(b.close, b.i) END AS late, 100 * (max(b.high) - min(b.low)) / avg(b.close) AS narrow FROM f JOIN n b ON b.symbol = f.symbol AND b.i BETWEEN f.i - f.k + 1 + f.k // 2 AND f.i GROUP BY f.symbol, f.i),
{_turns('low', 'min')}, {_turns('high', 'max')}, w AS ({_twins(True)}), tt AS ({_twins(False)}),
lv AS (SELECT f.*, round(hm + round(hs, 9) * (k - 1) / 2.0, 6) AS top, round(lm + round(ls, 9) * (k - 1) / 2.0, 6) AS floor_, w.neck AS wl, w.e AS we, tt.neck AS tl, tt.e AS te FROM f LEFT JOIN w USING (symbol, i) LEFT JOIN tt USING (symbol, i)),
bu AS ({_break('top', True)}), bd AS ({_break('floor_', False)}), bw AS ({_break('wl', True)}), bt AS ({_break('tl', False)}),
g AS (SELECT l.*, round(1 - sqrt(greatest(0.0, vp - cs * cs * (k * k - 1) / 12.0 - bend * bend * z2)) / (sqrt(vp) + 1e-8), 9) AS fit, bend, CASE WHEN upper > lower THEN round((now - lower) / (upper - lower), 9) ELSE 0.5 END AS pos, round((hi - lo) / m, 9) AS rng, round(100 * (mid / c0 - 1), 9) AS rise, round(late, 9) AS late, round(narrow, 9) AS narrow, trough, handle,
 bu.firm AND now > top AS over_, bd.firm AND now < floor_ AS under_, CASE WHEN now > top THEN bu.strength WHEN now < floor_ THEN bd.strength END AS broke, CASE WHEN now > top THEN top WHEN now < floor_ THEN floor_ END AS line, bw.firm AS wf, bw.strength AS ws, bt.firm AS tf, bt.strength AS ts,
 CASE WHEN k < 30 THEN NULL WHEN round(hs, 9) < 0 AND round(ls, 9) > 0 THEN 'symmetric' WHEN round(hs, 9) < -0.001 AND abs(round(ls, 9)) < abs(round(hs, 9)) * 0.3 THEN 'descending' WHEN round(ls, 9) > 0.001 AND abs(round(hs, 9)) < abs(round(ls, 9)) * 0.3 THEN 'ascending' END AS tri
 FROM lv l JOIN q USING (symbol, i) JOIN p USING (symbol, i) JOIN s USING (symbol, i) LEFT JOIN bu USING (symbol, i) LEFT JOIN bd USING (symbol, i) LEFT JOIN bw USING (symbol, i) LEFT JOIN bt USING (symbol, i)),
e AS (
 SELECT symbol, trade_date, 'symmetric_triangle' AS name, CASE WHEN over_ THEN 'bullish' WHEN under_ THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN over_ OR under_ THEN 80 ELSE 65 END AS confidence, line AS level, NULL AS target, broke AS strength, CASE WHEN over_ THEN 18 WHEN under_ THEN -18 ELSE 0 END AS points FROM g WHERE tri = 'symmetric'
 UNION ALL SELECT symbol, trade_date, 'descending_triangle', CASE WHEN over_ THEN 'bullish' ELSE 'bearish' END, CASE WHEN under_ THEN 82 WHEN over_ THEN 78 ELSE 68 END, line, NULL, broke, CASE WHEN under_ THEN -22 WHEN over_ THEN 8 ELSE -12 END FROM g WHERE tri = 'descending'
 UNION ALL SELECT symbol, trade_date, 'ascending_triangle', 'bullish', CASE WHEN over_ THEN 85 ELSE 70 END, line, NULL, broke, CASE WHEN over_ THEN 25 ELSE 15 END FROM g WHERE tri = 'ascending'
 UNION ALL SELECT symbol, trade_date, 'box', CASE WHEN pos < 0.3 THEN 'bullish' WHEN pos > 0.7 THEN 'bearish' ELSE 'neutral' END, 72, NULL, NULL, NULL, CASE WHEN pos < 0.3 THEN 10 WHEN pos > 0.7 THEN -10 ELSE 0 END FROM g WHERE k >= 30 AND rng < 0.15 AND abs(round(cs, 9)) < m * 0.001
 UNION ALL SELECT symbol, trade_date, CASE WHEN rise > 0 THEN 'bull_flag' ELSE 'bear_flag' END, CASE WHEN rise > 0 THEN 'bullish' ELSE 'bearish' END, 71, NULL, NULL, NULL, CASE WHEN rise > 0 THEN 14 ELSE -14 END FROM g WHERE k >= 30 AND narrow < 14 AND (rise > 2 AND late <= 0 OR rise < -2 AND late >= 0)
 UNION ALL SELECT symbol, trade_date, 'cup_and_handle', 'bullish', 75, trough, NULL, NULL, 18 FROM g WHERE k >= 40 AND c0 > trough AND now > trough AND now > c0 * 0.95 AND trough < c0 * 0.97 AND now < handle
 UNION ALL SELECT symbol, trade_date, CASE WHEN bend > 0 THEN 'rounding_bottom' ELSE 'rounding_top' END, CASE WHEN bend > 0 THEN 'bullish' ELSE 'bearish' END, CAST(floor(60 + fit * 15) AS INTEGER), NULL, NULL, NULL, CASE WHEN bend > 0 THEN 15 ELSE -15 END FROM g WHERE k >= 40 AND fit > 0.5 AND (bend > 0 AND now > m OR bend < 0 AND now < m)
 UNION ALL SELECT symbol, trade_date, 'double_bottom', 'bullish', CASE WHEN wf THEN 85 ELSE 75 END, wl, 2 * wl - we, ws, CASE WHEN wf THEN 20 WHEN now > wl * 0.97 THEN 8 ELSE 0 END FROM g WHERE we IS NOT NULL
 UNION ALL SELECT symbol, trade_date, 'double_top', 'bearish', CASE WHEN tf THEN 85 ELSE 75 END, tl, 2 * tl - te, ts, CASE WHEN tf THEN -20 WHEN now < tl * 1.03 THEN -8 ELSE 0 END FROM g WHERE te IS NOT NULL)"""


def rows_of(d, array: str):
    """A row for each element of an array of structs. An outer explode: of a plain one Spark makes a filter on the array, which it pushes through all stages of the frame's expressions, each time in full."""
    others = [c for c in d.columns if c != array]
    return d.select(*others, F.explode_outer(array).alias("__x")).where("__x IS NOT NULL").select(*others, "__x.*")


def patterns(spark, sf_dir):
    """The fixture's prices move by a few percent: pole, drift and cup are cut to that."""
    return shapes.chart_patterns(t(spark, sf_dir, "bars"), pole=2.0, flag=14.0, depth=0.03)


@query(f"{_PATTERNS} SELECT symbol, trade_date, name, direction, confidence, {{level AS level}}, {{target AS target}}, CAST(strength AS INTEGER) AS strength, CAST(greatest(-40, least(40, sum(points) OVER (PARTITION BY symbol, trade_date))) AS INTEGER) AS score FROM e")
def d08_chart_patterns(spark, sf_dir):
    """One row for each pattern that a bar shows, beside the bar's score."""
    return rows_of(patterns(spark, sf_dir), "patterns")


@query("")
def d09_zones(spark, sf_dir):
    """The zones of each symbol's strokes; folds, tested against their definitions."""
    return rows_of(zones.zone_state(t(spark, sf_dir, "bars")).select("symbol", "zones"), "zones")


@query("")
def d09_points(spark, sf_dir):
    """The points of entry and exit that each symbol's last stroke makes, beside the symbol's score."""
    return rows_of(zones.zone_state(t(spark, sf_dir, "bars")).select("symbol", "trade_date", "score", "points"), "points")


# Levels --------------------------------------------------------------------------------------------------

_L120 = f"({W_} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"
_MA = ", ".join(f"CASE WHEN count(*) OVER ({W_} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER ({W_} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END" for n in levels.MEANS)
_LEVELS = f"""f0 AS (SELECT symbol, trade_date, close AS now, CAST(row_number() OVER ({W_}) AS INTEGER) AS i, high, low, vol, list(high) OVER {_L120} AS h, list(low) OVER {_L120} AS l, [{_MA}] AS means FROM bars),
f AS (SELECT *, len(h) AS k, greatest(5, len(h) // 15) AS w FROM f0 WHERE len(h) >= 30),
sw AS (SELECT symbol, trade_date, now, h, l, k, w, unnest(range(w + 1, k)) AS j FROM f),
bins AS (SELECT f.symbol, f.trade_date, f.now, f.i, min(x.low) AS lo, max(x.high) AS hi FROM f JOIN f0 x ON x.symbol = f.symbol AND x.i BETWEEN f.i - 59 AND f.i WHERE f.k >= 60 GROUP BY ALL),
vp AS (SELECT b.symbol, b.trade_date, b.now, lo + (hi - lo) * j / 20 AS e0, lo + (hi - lo) * (j + 1) / 20 AS e1, row_number() OVER (PARTITION BY b.symbol, b.i ORDER BY round(sum(CASE WHEN x.low <= lo + (hi - lo) * (j + 1) / 20 AND x.high >= lo + (hi - lo) * j / 20 THEN x.vol ELSE 0 END), 3) DESC, j DESC) AS o
 FROM bins b, (SELECT CAST(unnest(range(20)) AS INTEGER) AS j) JOIN f0 x ON x.symbol = b.symbol AND x.i BETWEEN b.i - 59 AND b.i WHERE hi > lo GROUP BY b.symbol, b.trade_date, b.now, b.i, lo, hi, j),
gp AS (SELECT f.symbol, f.trade_date, f.now, y.high AS h0, y.low AS l0, x.high AS h1, x.low AS l1 FROM f JOIN f0 x ON x.symbol = f.symbol AND x.i BETWEEN f.i - 59 AND f.i JOIN f0 y ON y.symbol = x.symbol AND y.i = x.i - 1 WHERE y.i > f.i - 120),
rn AS (SELECT symbol, trade_date, now, (round(now / u) + m) * u AS price FROM (SELECT *, power(10.0, greatest(0.0, floor(log10(now + 1e-8)) - 1)) AS u FROM f), (SELECT unnest([-1, 0, 1]) AS m)),
raw AS (
 SELECT symbol, trade_date, now, CASE WHEN h[j] > now THEN 'resistance' ELSE 'support' END AS side, 'swing_high' AS label, h[j] AS price FROM sw WHERE h[j] = list_max(h[j - w : j + w]) AND h[j] > h[j - 1]
 UNION ALL SELECT symbol, trade_date, now, CASE WHEN l[j] < now THEN 'support' ELSE 'resistance' END, 'swing_low', l[j] FROM sw WHERE l[j] = list_min(l[j - w : j + w]) AND l[j] < l[j - 1]
 UNION ALL SELECT symbol, trade_date, now, CASE WHEN m < now THEN 'support' WHEN m > now THEN 'resistance' END, 'mean', m FROM (SELECT symbol, trade_date, now, unnest(means) AS m FROM f) WHERE abs(m - now) / now < 0.05
 UNION ALL SELECT symbol, trade_date, now, CASE WHEN (e0 + e1) / 2 < now THEN 'support' WHEN (e0 + e1) / 2 > now THEN 'resistance' END, 'volume', (e0 + e1) / 2 FROM vp WHERE o <= 3 AND abs((e0 + e1) / 2 - now) / now < 0.08
 UNION ALL SELECT symbol, trade_date, now, 'support', 'gap', h0 FROM gp WHERE l1 > h0 AND h0 < now UNION ALL SELECT symbol, trade_date, now, 'resistance', 'gap', l0 FROM gp WHERE h1 < l0 AND l0 > now
 UNION ALL SELECT symbol, trade_date, now, CASE WHEN price < now THEN 'support' WHEN price > now THEN 'resistance' END, 'round', price FROM rn WHERE price > 0 AND abs(price - now) / now < 0.06),
cd AS (SELECT DISTINCT symbol, trade_date, now, side, label, round(price + 3e-9, 2) AS price FROM raw WHERE side IS NOT NULL),
isl AS (SELECT *, sum(new) OVER (PARTITION BY symbol, trade_date, side ORDER BY price, label ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN round(price - lag(price) OVER (PARTITION BY symbol, trade_date, side ORDER BY price, label), 6) <= round(now * 0.002, 6) THEN 0 ELSE 1 END AS new FROM cd)),
cl AS (SELECT symbol, trade_date, now, side, round(avg(price) + 3e-9, 6) AS price, min(price) AS low, max(price) AS high, count(*) AS strength, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM isl GROUP BY symbol, trade_date, now, side, island),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, trade_date, side ORDER BY round(abs(price - now), 6), price) AS INTEGER) AS rank FROM cl)"""


def level_rows(spark, sf_dir):
    return levels.clustered(levels.candidates(t(spark, sf_dir, "bars")))


@query(f"{_LEVELS} SELECT symbol, trade_date, side, rank, {{price AS price}}, {{low AS low}}, {{high AS high}}, strength, labels FROM rk")
def d05_level_clusters(spark, sf_dir):
    """Every bar's support and resistance levels, the nearest first."""
    return level_rows(spark, sf_dir).drop("now")


_NEAR = lambda s, c: f"max(CASE WHEN side = '{s}' AND rank = 1 THEN {c} END)"


@query(f"{_LEVELS}, ps AS (SELECT symbol, trade_date, max(now) AS now, {_NEAR('support', 'price')} AS s, {_NEAR('resistance', 'price')} AS r, {_NEAR('support', 'strength')} AS ss, {_NEAR('resistance', 'strength')} AS rs FROM rk GROUP BY symbol, trade_date), sh AS (SELECT *, round((now - s) / (CASE WHEN r > s THEN r - s WHEN r <= s THEN 1 END), 9) AS share FROM ps) SELECT symbol, trade_date, {{s AS support}}, {{r AS resistance}}, ss AS support_strength, rs AS resistance_strength, CASE WHEN share < 0.25 THEN 'near_support' WHEN share > 0.75 THEN 'near_resistance' ELSE 'middle' END AS position, CASE WHEN s IS NULL THEN -10 WHEN r IS NULL THEN 10 WHEN share < 0.25 THEN 15 WHEN share > 0.75 THEN -15 ELSE 0 END AS score FROM sh")
def d05_price_position(spark, sf_dir):
    """Where every bar's close stands between its nearest levels."""
    return levels.position(level_rows(spark, sf_dir))


# Divergences ---------------------------------------------------------------------------------------------


def _pair(name: str, x: str, sign: int) -> str:
    """The last two turns known at each row, by joining rows to those before them."""
    y, most = (f"{'-' if sign < 0 else ''}{x}"), "max"
    return f"""t_{name} AS (SELECT symbol, i, {x}, dif, rsi, {y} AS y, CASE WHEN count(*) OVER b = 5 THEN {most}({y}) OVER b END AS lm FROM inp WINDOW b AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
k_{name} AS (SELECT a.symbol, a.i AS ni, p.i, p.{x} AS x, p.dif, p.rsi FROM inp a JOIN t_{name} p ON p.symbol = a.symbol AND p.i <= a.i AND a.i - p.i < 195 WHERE p.y >= p.lm AND NOT EXISTS (SELECT 1 FROM t_{name} x WHERE x.symbol = p.symbol AND x.i > p.i AND x.i <= least(p.i + 5, a.i) AND x.y > p.y)),
r_{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol, ni ORDER BY i DESC) AS o FROM k_{name}),
d_{name} AS (SELECT b.symbol, b.ni, b.i, {sign} * (b.x - a.x) > 0 AND {sign} * (a.dif - b.dif) > 0 AS m, {sign} * (b.x - a.x) > 0 AND {sign} * (a.rsi - b.rsi) > 2 AS r, least(1.0, round(abs(a.dif - b.dif) / greatest(abs(a.dif), abs(b.dif), 1e-6), 9)) AS mm, least(1.0, round(abs(a.rsi - b.rsi) / 25, 9)) AS rm FROM r_{name} a JOIN r_{name} b ON a.symbol = b.symbol AND a.ni = b.ni AND a.o = 2 AND b.o = 1 WHERE b.ni >= 39)"""


_INPUTS = shapes.pivot_inputs()
_I, _LAST_I = _INPUTS.sql("bars").rsplit("\nSELECT ", 1)
_PTS = lambda n: f"CASE WHEN {n}.m THEN 15 + floor({n}.mm * 15) ELSE 0 END + CASE WHEN {n}.r THEN 12 + floor({n}.rm * 13) ELSE 0 END + CASE WHEN {n}.m AND {n}.r THEN 15 ELSE 0 END"
_AGO = lambda n: f"CASE WHEN {n}.m OR {n}.r THEN inp.i - {n}.i END"


@query(f"{_I}, inp AS (SELECT {_LAST_I}), {_pair('top', 'high', 1)}, {_pair('bot', 'low', -1)} SELECT inp.symbol, trade_date, coalesce(d_top.m, false) AS macd_top, coalesce(d_bot.m, false) AS macd_bottom, coalesce(d_top.r, false) AS rsi_top, coalesce(d_bot.r, false) AS rsi_bottom, {{greatest(CASE WHEN d_top.m THEN d_top.mm ELSE 0 END, CASE WHEN d_bot.m THEN d_bot.mm ELSE 0 END) AS macd_magnitude}}, {{greatest(CASE WHEN d_top.r THEN d_top.rm ELSE 0 END, CASE WHEN d_bot.r THEN d_bot.rm ELSE 0 END) AS rsi_magnitude}}, CAST(least({_AGO('d_top')}, {_AGO('d_bot')}) AS INTEGER) AS bars_ago, CAST(greatest(-100, least(100, {_PTS('d_bot')} - ({_PTS('d_top')}))) AS INTEGER) AS score FROM inp LEFT JOIN d_top ON d_top.symbol = inp.symbol AND d_top.ni = inp.i LEFT JOIN d_bot ON d_bot.symbol = inp.symbol AND d_bot.ni = inp.i")
def d03_pivot_divergences(spark, sf_dir):
    """Divergences of dif and rsi between the last two tops and bottoms known at every bar."""
    return shapes.divergences(_INPUTS.apply(t(spark, sf_dir, "bars")))


# Candles -------------------------------------------------------------------------------------------------


@query(f"{candles.sql()} SELECT symbol, trade_date, {{place AS place}}, name, direction, CAST(confidence AS INTEGER) AS confidence FROM cp")
def d01_all_candles(spark, sf_dir):
    """Every candle pattern of every bar with its confidence."""
    return rows_of(candles.candle_patterns(t(spark, sf_dir, "bars")), "patterns")
