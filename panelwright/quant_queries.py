"""Registered queries of the quant score over series of different frequency, aligned as of each bar, with SQL of their own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layer_queries import MAIN, _CTE
from .operators import panels as P
from .operators import quant, shapes
from .operators.features import FEATURES
from .panel_queries import W_, query, t
from .shape_queries import rows_of

SMALL = "buy_sm_amount - sell_sm_amount"
#: The fixture's prices move by half of what daily bars do over 60 rows.
MOVES = 0.5


def divergence(main: Column, small: Column) -> Column:
    """What main and small money do together."""
    return F.when((main < 0) & (small > 0), "distribution").when((main > 0) & (small < 0), "smart_accumulating").when((main > 0) & (small > 0), "consensus_buy").when((main < 0) & (small < 0), "consensus_sell").otherwise("neutral")


def aligned(spark, sf_dir) -> DataFrame:
    """Every bar beside the state of four slower or equal series at its date: flow by week, winners by month, holders by quarter."""
    w, c = P.by_time(), F.col("close")
    back = lambda n: w.rowsBetween(1 - n, 0)
    panel = t(spark, sf_dir, "panel")
    d = panel.withColumns({"tp": (F.col("high") + F.col("low") + c) / 3, "before": F.lag("close").over(w)})
    d = d.withColumns({"up": F.greatest(c - F.col("before"), F.lit(0.0)), "down": F.greatest(F.col("before") - c, F.lit(0.0)), "in_": F.when(F.col("tp") > F.lag("tp").over(w), F.col("tp") * F.col("vol")), "out_": F.when(F.col("tp") < F.lag("tp").over(w), F.col("tp") * F.col("vol")), "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before")))})
    full = lambda n: F.count("before").over(back(n)) == n
    ups, downs = (F.coalesce(F.sum(x).over(back(14)), F.lit(0.0)) for x in ("in_", "out_"))
    d = d.select(
        "symbol", "trade_date", F.col("total_mv").alias("mv"), "pe", F.when(F.count("close").over(back(60)) == 60, F.round(c / F.avg("close").over(back(60)) - 1, 9)).alias("ma_ratio_60"), F.when(full(14), F.round(100 * ups / F.nullif(ups + downs, F.lit(0.0)), 9)).alias("mfi"),
        F.when(full(24), F.round(100 * F.avg("up").over(back(24)) / F.nullif(F.avg("up").over(back(24)) + F.avg("down").over(back(24)), F.lit(0.0)), 9)).alias("rsi_24"), F.when(full(14), F.round(F.avg("tr").over(back(14)) / c, 9)).alias("atr_pct"),
    )
    bars = t(spark, sf_dir, "bars")
    adx = FEATURES["w07_adx"]().apply(bars).select("symbol", "trade_date", "adx", "pdi", "mdi")
    trix = FEATURES["w12_trix"]().apply(bars).select("symbol", "trade_date", "trix")
    f = t(spark, sf_dir, "panel_flow").select("symbol", "trade_date", "amount", F.round(F.expr(MAIN), 2).alias("main"), F.round(F.expr(SMALL), 2).alias("small"))
    f = f.withColumn("off", F.when(F.col("main") > 0, 0).otherwise(1)).withColumn("spell", F.sum("off").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mean3 = lambda x: F.round(F.avg(x).over(back(3)), 6)
    days = F.sum(1 - F.col("off")).over(Window.partitionBy("symbol", "spell").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    f = f.select("symbol", "trade_date", divergence(mean3("main"), mean3("small")).alias("divergence"), mean3(100 * F.col("main") / F.col("amount")).alias("main_rate_ma3"), mean3("main").alias("main_net_ma3"), days.alias("main_days"))
    # The share of the last 60 rows' volume that was traded at or under the close, noted at each month's last bar.
    chips = shapes.framed(bars).where("k >= 20")
    under = shapes.total(F.transform(F.filter(F.arrays_zip("c", "v"), lambda x: x["c"] <= shapes.last(F.col("c"))), lambda x: x["v"])) / shapes.total(F.col("v"))
    month = Window.partitionBy("symbol", F.date_trunc("month", "trade_date"))
    chips = chips.select("symbol", "trade_date", F.round(100 * under, 6).alias("winner_rate"), F.max("trade_date").over(month).alias("end")).where("trade_date = end").drop("end")
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", "trade_date"), 2))
    reports = t(spark, sf_dir, "signals").groupBy("symbol", quarter.alias("trade_date")).agg(F.count(F.lit(1)).alias("n"))
    reports = reports.select("symbol", "trade_date", F.round(100 * (F.col("n") / F.lag("n").over(w) - 1), 6).alias("holder_pct")).where("holder_pct IS NOT NULL")
    key = ["symbol", "trade_date"]
    d = d.join(adx, key, "left").join(trix, key, "left").join(f, key, "left")
    d = P.as_of(d, chips, ["winner_rate"]).drop("as_of")
    return P.as_of(d, reports, ["holder_pct"]).drop("as_of")


def _spec(name: str, alias: str) -> str:
    return f"{alias} AS (WITH {FEATURES[name]().sql('bars')})"


_F = lambda n: f"({W_} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_STEPS = """CASE WHEN adx IS NULL OR pdi IS NULL OR mdi IS NULL THEN NULL WHEN pdi > mdi THEN CASE WHEN adx >= 30 THEN 10 WHEN adx >= 25 THEN 6 WHEN adx < 20 THEN -2 END WHEN adx >= 25 THEN -8 WHEN adx < 20 THEN -2 END AS adx_,
 CASE WHEN winner_rate <= 20 THEN 12 WHEN winner_rate <= 35 THEN 6 WHEN winner_rate < 75 THEN NULL WHEN winner_rate < 85 THEN -5 WHEN winner_rate >= 85 THEN -10 END AS winner_rate_,
 CASE divergence WHEN 'distribution' THEN -12 WHEN 'smart_accumulating' THEN 8 WHEN 'consensus_buy' THEN 3 WHEN 'consensus_sell' THEN -5 END AS mf_divergence_,
 CASE WHEN rate IS NOT NULL THEN CASE WHEN abs(rate) >= 3 THEN 10 * sign(rate) WHEN abs(rate) >= 1 THEN 5 * sign(rate) END WHEN abs(net) >= 5000 THEN 10 * sign(net) WHEN abs(net) >= 1000 THEN 5 * sign(net) END AS mf_strength_,
 CASE WHEN main_days >= 5 THEN 5 WHEN main_days >= 3 THEN 3 END AS mf_consecutive_,
 CASE WHEN abs(holder_pct) > 500 THEN NULL WHEN holder_pct <= -5 THEN 8 WHEN holder_pct <= -2 THEN 4 WHEN holder_pct < 2 THEN NULL WHEN holder_pct < 5 THEN -3 WHEN holder_pct >= 5 THEN -6 END AS holders_,
 CASE WHEN mv < 100 THEN CASE WHEN ma_ratio_60 < -0.02 THEN 6 WHEN ma_ratio_60 > 0.05 THEN -6 WHEN ma_ratio_60 > 0.02 THEN -3 END WHEN mv >= 1000 THEN CASE WHEN ma_ratio_60 > 0.02 THEN 5 WHEN ma_ratio_60 < -0.02 THEN -3 END END AS layer_ma_ratio60_,
 CASE WHEN mv >= 300 THEN CASE WHEN mfi >= 75 THEN 5 WHEN mfi >= 60 THEN 3 END WHEN mv < 100 AND mfi >= 80 THEN -3 END AS layer_mfi_,
 CASE WHEN mv >= 1000 THEN CASE WHEN rsi_24 >= 65 THEN 4 WHEN rsi_24 >= 55 THEN 2 WHEN rsi_24 <= 35 THEN -2 END END AS layer_rsi24_,
 CASE WHEN mv < 100 AND abs(trix) > 0.5 THEN -3 * sign(trix) END AS layer_trix_,
 CASE WHEN pe > 0 AND pe < 15 THEN CASE WHEN atr_pct > 0.04 THEN 2 END WHEN pe < 0 OR pe >= 100 THEN CASE WHEN atr_pct > 0.05 THEN -4 END END AS layer_pe_atr_"""
_NAMES = ("adx", "winner_rate", "mf_divergence", "mf_strength", "mf_consecutive", "holders", "layer_ma_ratio60", "layer_mfi", "layer_rsi24", "layer_trix", "layer_pe_atr")
_ALIGNED = f"""{_CTE('flow')}, {_CTE('signals')}, {_spec('w07_adx', 'ax')}, {_spec('w12_trix', 'tx')},
q1 AS (SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER ({W_}) AS before FROM panel),
q2 AS (SELECT *, lag(tp) OVER ({W_}) AS tp0, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM q1),
q3 AS (SELECT *, coalesce(sum(CASE WHEN tp > tp0 THEN tp * vol END) OVER {_F(14)}, 0) AS ups, coalesce(sum(CASE WHEN tp < tp0 THEN tp * vol END) OVER {_F(14)}, 0) AS downs, avg(CASE WHEN before IS NOT NULL THEN greatest(close - before, 0) END) OVER {_F(24)} AS u, avg(CASE WHEN before IS NOT NULL THEN greatest(before - close, 0) END) OVER {_F(24)} AS e, count(before) OVER {_F(14)} AS n14, count(before) OVER {_F(24)} AS n24, count(*) OVER {_F(60)} AS n60, avg(close) OVER {_F(60)} AS ma60, avg(tr) OVER {_F(14)} AS atr FROM q2),
q4 AS (SELECT symbol, trade_date, total_mv AS mv, pe, CASE WHEN n60 = 60 THEN round(close / ma60 - 1, 9) END AS ma_ratio_60, CASE WHEN n14 = 14 THEN round(100 * ups / nullif(ups + downs, 0), 9) END AS mfi, CASE WHEN n24 = 24 THEN round(100 * u / nullif(u + e, 0), 9) END AS rsi_24, CASE WHEN n14 = 14 THEN round(atr / close, 9) END AS atr_pct FROM q3),
f1 AS (SELECT symbol, trade_date, amount, round({MAIN}, 2) AS main, round({SMALL}, 2) AS small FROM bars JOIN flow USING (symbol, trade_date)),
f2 AS (SELECT *, round(avg(main) OVER {_F(3)}, 6) AS m3, round(avg(small) OVER {_F(3)}, 6) AS s3, round(avg(100 * main / amount) OVER {_F(3)}, 6) AS rate FROM f1),
f3 AS (SELECT a.symbol, a.trade_date, a.m3 AS net, a.rate, CASE WHEN a.m3 < 0 AND a.s3 > 0 THEN 'distribution' WHEN a.m3 > 0 AND a.s3 < 0 THEN 'smart_accumulating' WHEN a.m3 > 0 AND a.s3 > 0 THEN 'consensus_buy' WHEN a.m3 < 0 AND a.s3 < 0 THEN 'consensus_sell' ELSE 'neutral' END AS divergence, (SELECT count(*) FROM f1 b WHERE b.symbol = a.symbol AND b.trade_date <= a.trade_date AND b.trade_date > coalesce((SELECT max(c.trade_date) FROM f1 c WHERE c.symbol = a.symbol AND c.trade_date <= a.trade_date AND c.main <= 0), DATE '1900-01-01')) AS main_days FROM f2 a),
b1 AS (SELECT *, row_number() OVER ({W_}) AS i, trade_date = max(trade_date) OVER (PARTITION BY symbol, date_trunc('month', trade_date)) AS month_end FROM bars),
wr AS (SELECT a.symbol, a.trade_date, round(100 * sum(CASE WHEN x.close <= a.close THEN x.vol ELSE 0 END) / sum(x.vol), 6) AS winner_rate FROM b1 a JOIN b1 x ON x.symbol = a.symbol AND x.i BETWEEN a.i - 59 AND a.i WHERE a.month_end AND a.i >= 20 GROUP BY a.symbol, a.trade_date),
hr AS (SELECT symbol, CAST(date_trunc('quarter', trade_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS trade_date, count(*) AS n FROM signals GROUP BY ALL),
hp AS (SELECT symbol, trade_date, round(100 * (n / lag(n) OVER ({W_}) - 1), 6) AS holder_pct FROM hr),
al AS (SELECT q4.*, adx, pdi, mdi, trix, net, rate, divergence, main_days, winner_rate, holder_pct FROM q4 LEFT JOIN ax USING (symbol, trade_date) LEFT JOIN tx USING (symbol, trade_date) LEFT JOIN f3 USING (symbol, trade_date) ASOF LEFT JOIN wr ON wr.symbol = q4.symbol AND wr.trade_date <= q4.trade_date ASOF LEFT JOIN (SELECT * FROM hp WHERE holder_pct IS NOT NULL) hq ON hq.symbol = q4.symbol AND hq.trade_date <= q4.trade_date),
st AS (SELECT symbol, trade_date, {_STEPS} FROM al)"""
_SUM = " + ".join(f"coalesce({n}_, 0)" for n in _NAMES)


@query(f"{_ALIGNED} SELECT symbol, trade_date, {{greatest(0.0, least(100.0, 50 + {_SUM})) AS score}}, {{{_SUM} AS total}} FROM st", "panel")
def sr13_quant_score(spark, sf_dir):
    """The quant score of every bar."""
    return quant.quant_score(aligned(spark, sf_dir), moves=MOVES).drop("adjustments")


@query(f"{_ALIGNED} " + " UNION ALL ".join(f"SELECT symbol, trade_date, '{n}' AS factor, {{{n}_ AS delta}} FROM st WHERE {n}_ IS NOT NULL" for n in _NAMES), "panel")
def sr13_adjustments(spark, sf_dir):
    """Which ladders moved each bar's score, and by how much."""
    return rows_of(quant.quant_score(aligned(spark, sf_dir), moves=MOVES).select("symbol", "trade_date", "adjustments"), "adjustments")
