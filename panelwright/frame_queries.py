"""Registered queries over several time frames: resonance with a veto, hourly signals beside days; SQL of their own."""
from __future__ import annotations

from pyspark.sql import functions as F

from .operators import resonance as R
from .operators.features import FEATURES
from .operators.spec import doubles, rounded
from .panel_queries import ORACLE_SQL, QUERIES, W_, query, rounding, t
from .source_queries import ticks

_B = lambda n: f"({W_} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_M = lambda n: f"CASE WHEN count(*) OVER {_B(n)} = {n} THEN avg(close) OVER {_B(n)} END AS ma{n}"
_DONE = lambda unit, months: f"SELECT symbol, CAST(start + INTERVAL {months} MONTH AS DATE) AS trade_date, sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bulls, round(100 * (close / open - 1), 9) AS body FROM (SELECT symbol, date_trunc('{unit}', trade_date) AS start, arg_min(open, trade_date) AS open, arg_max(close, trade_date) AS close FROM bars GROUP BY ALL)"
_STATES = f"""n AS (SELECT symbol, trade_date, close, row_number() OVER ({W_}) AS i, lag(close, 20) OVER ({W_}) AS c20, {_M(5)}, {_M(20)}, {_M(60)}, {_M(120)} FROM bars),
sl AS (SELECT *, CASE WHEN ma20 IS NOT NULL THEN round(100 * regr_slope(close, i) OVER {_B(20)} / ma20, 9) END AS slope FROM n),
pc AS (SELECT *, round(100 * (close / ma20 - 1), 9) AS p20, round(100 * (close / ma60 - 1), 9) AS p60, round(100 * (close / ma120 - 1), 9) AS p120, round(100 * (ma20 / ma60 - 1), 9) AS m20, round(100 * (ma5 / ma20 - 1), 9) AS m5, round(100 * (close / c20 - 1), 9) AS mom FROM sl),
mo AS ({_DONE('month', 1)}), qu AS ({_DONE('quarter', 3)}),
al AS (SELECT pc.*, mo.bulls, qu.body FROM pc ASOF LEFT JOIN mo ON mo.symbol = pc.symbol AND mo.trade_date <= pc.trade_date ASOF LEFT JOIN qu ON qu.symbol = pc.symbol AND qu.trade_date <= pc.trade_date),
h0 AS (SELECT *, CASE WHEN ma60 IS NULL THEN 0 WHEN ma120 IS NULL THEN CASE WHEN p60 > 1.2 AND m20 > 0 THEN 1 WHEN p60 < -2 THEN -1 ELSE 0 END WHEN p60 > 0 AND m20 > 0 THEN CASE WHEN p120 > 0 AND p60 > 1.2 THEN 2 ELSE 1 END WHEN p60 < 0 AND m20 < 0 THEN CASE WHEN p120 < 0 AND p60 < -2 THEN -2 ELSE -1 END ELSE 0 END AS h,
 CASE WHEN p20 > 0 AND m5 > 0 AND slope > 0 THEN CASE WHEN slope > 0.05 AND p20 > 1.2 THEN 2 ELSE 1 END WHEN p20 < 0 AND m5 < 0 THEN CASE WHEN slope < -0.05 THEN -2 ELSE -1 END ELSE 0 END AS m,
 CASE WHEN slope > 0 AND mom > 0 THEN CASE WHEN slope > 0.03 AND mom > 2 THEN 2 ELSE 1 END WHEN slope < 0 AND mom < 0 THEN CASE WHEN slope < -0.03 AND mom < -2 THEN -2 ELSE -1 END ELSE 0 END AS b FROM al),
st AS (SELECT symbol, trade_date, CASE WHEN body < -2 THEN least(h, -1) ELSE h END AS high, CASE WHEN bulls >= 3 AND m >= 0 THEN greatest(m, 1) WHEN bulls = 0 AND m <= 0 THEN least(m, -1) ELSE m END AS middle, b AS base FROM h0)"""


@query(f"{_STATES} SELECT symbol, trade_date, high, middle, base, CAST(CASE WHEN least(high, middle, base) >= 1 THEN 75 + (high + middle + base - 3) * 4 WHEN greatest(high, middle, base) <= -1 THEN 25 + (high + middle + base + 3) * 4 WHEN high = 2 THEN CASE WHEN middle >= 1 THEN 70 WHEN middle = 0 THEN 60 ELSE 50 END WHEN high = 1 THEN CASE WHEN middle >= 1 THEN 65 WHEN middle = 0 THEN 55 ELSE 45 END WHEN high = -2 THEN CASE WHEN base >= 1 THEN 22 ELSE 18 END WHEN high = -1 THEN CASE WHEN base >= 1 THEN 32 WHEN middle <= -1 THEN 28 ELSE 38 END WHEN middle <> 0 THEN CASE middle WHEN 2 THEN 65 WHEN 1 THEN 58 WHEN -1 THEN 42 ELSE 32 END WHEN base >= 1 THEN 53 WHEN base <= -1 THEN 47 ELSE 50 END AS INTEGER) AS score FROM st")
def sr02_frames(spark, sf_dir):
    """Bars of weeks beside finished months and quarters; the fixture's moves are two fifths of what the percents are made for."""
    d = R.states(t(spark, sf_dir, "bars"), moves=0.4)
    return d.withColumn("score", R.resonance(F.col("high"), F.col("middle"), F.col("base")))


_HOURS = FEATURES["w47_hourly_signals"]()
_HOURLY = "bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS trade_date, arg_min(value, row(ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, value)) AS close, CAST(count(*) AS DOUBLE) AS vol FROM events GROUP BY ALL)"


def hours(spark, sf_dir):
    """Ticks as bars of an hour; an hour's volume is its number of ticks."""
    tie = F.struct("ts", "price")
    d = ticks(spark, sf_dir).groupBy("symbol", F.date_trunc("hour", "ts").alias("trade_date"))
    return d.agg(F.min_by("price", tie).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", tie).alias("close"), F.count(F.lit(1)).cast("double").alias("vol"))


def w47_events_by_hour(spark, sf_dir):
    """Hourly signals as they stood at the end of every day that has ticks, from bars of real hours."""
    d = _HOURS.apply(hours(spark, sf_dir)).withColumn("day", F.to_date("trade_date"))
    last = d.groupBy("symbol", "day").agg(F.max_by(F.struct(*_HOURS.keep), "trade_date").alias("x"), F.count(F.lit(1)).alias("hours"))
    return last.select("symbol", "day", "hours", "x.*")


QUERIES["w47_events_by_hour"] = lambda spark, sf_dir: rounding(w47_events_by_hour(spark, sf_dir))
ORACLE_SQL["w47_events_by_hour"] = doubles(
    f"WITH {_HOURLY}, h AS (WITH n AS (SELECT *, lag(close) OVER ({W_}) AS pc, {_M(5)}, {_M(20)}, CASE WHEN count(*) OVER {_B(3)} = 3 THEN avg(vol) OVER {_B(3)} END AS v3, CASE WHEN count(*) OVER {_B(20)} = 20 THEN avg(vol) OVER {_B(20)} END AS v20 FROM bars), "
    f"m AS (SELECT *, ma5 / nullif(lag(ma5, 3) OVER ({W_}), 0) - 1 AS slope_5, CASE WHEN ma5 > ma20 THEN 1.0 ELSE 0.0 END AS above, v3 / nullif(v20, 0) AS volume_3_20, count(pc) OVER {_B(14)} AS k, sum(CASE WHEN close > pc THEN close - pc ELSE 0 END) OVER {_B(14)} AS su, sum(abs(close - pc)) OVER {_B(14)} AS moved FROM n) "
    "SELECT *, CASE WHEN k = 14 THEN 100 * su / nullif(moved, 0) END AS rsi_14, 50 + 15 * (2 * above - 1) + least(15, greatest(-15, CASE WHEN slope_5 IS NOT NULL THEN slope_5 * 1000 END)) + least(10, greatest(-10, (volume_3_20 - 1) * 10)) AS s FROM m) "
    f"SELECT symbol, CAST(trade_date AS DATE) AS day, count(*) OVER (PARTITION BY symbol, CAST(trade_date AS DATE)) AS hours, {', '.join(f'{rounded(x, 6)} AS {n}' for n, x in (('slope_5', 'slope_5'), ('above', 'above'), ('volume_3_20', 'volume_3_20'), ('rsi_14', 'rsi_14'), ('intraday_score', 'CASE WHEN slope_5 IS NULL OR volume_3_20 IS NULL THEN NULL ELSE s END')))} FROM h QUALIFY row_number() OVER (PARTITION BY symbol, CAST(trade_date AS DATE) ORDER BY trade_date DESC) = 1"
)
