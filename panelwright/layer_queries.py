"""Registered queries of the sparse layered score over a validity table of the panel, with SQL of their own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import layers
from .operators import panels as P
from .operators.spec import rounded
from .panel_queries import W_, bucket_sql, lab, query, t
from .shape_queries import rows_of
from .sources.fixtures import CTES, market, panel
from .sources.scratch import kept

FACTORS = ("ma_ratio_20", "ma_ratio_60", "ma20_ma60", "ma5_ma20", "channel_pos_60", "sump_20", "roc_20", "mfi_14", "atr_pct")
MAIN = "buy_lg_amount + buy_elg_amount - sell_lg_amount - sell_elg_amount"


def trend_of(ret: Column) -> Column:
    """The market's trend by its return over 20 rows, in percent; the fixture's market moves little."""
    return F.when(ret > 0.5, "fast_bull").when(ret > 0, "slow_bull").when(ret < -0.5, "bear").otherwise("sideways")


def flow_state(net: Column, n: Column, ins: Column, outs: Column) -> Column:
    return F.when(ins == 3, "main_inflow_3d").when(outs == 3, "main_outflow_3d").when(net > 0, "main_inflow").when(n >= 3, "neutral")


def wide(spark, sf_dir) -> DataFrame:
    """Factors, the return of the next 20 rows and the context of every bar. Lines are read for the bars and their flow, which are written, and for the holdings."""
    w = P.by_time()
    both = kept(t(spark, sf_dir, "panel_flow"), "bars")
    bars = both.drop(*(x for x in both.columns if x.startswith(("buy_", "sell_"))))
    d = P.forward(panel(spark, sf_dir, bars), (20,))
    back, c = (lambda n: w.rowsBetween(1 - n, 0)), F.col("close")
    mean = lambda x, n: F.when(F.count(x).over(back(n)) == n, F.avg(x).over(back(n)))
    d = d.withColumns({"tp": (F.col("high") + F.col("low") + c) / 3, "before": F.lag("close").over(w), "ma5": mean("close", 5), "ma20": mean("close", 20), "ma60": mean("close", 60)})
    d = d.withColumns({"up": F.when(F.col("tp") > F.lag("tp").over(w), F.col("tp") * F.col("vol")), "dn": F.when(F.col("tp") < F.lag("tp").over(w), F.col("tp") * F.col("vol")), "gain": F.greatest(100 * (c / F.col("before") - 1), F.lit(0.0)), "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before")))})
    full = lambda n: F.count("before").over(back(n)) == n
    lo, hi = F.min("low").over(back(60)), F.max("high").over(back(60))
    ups, downs = (F.coalesce(F.sum(x).over(back(14)), F.lit(0.0)) for x in ("up", "dn"))
    made = {
        "ma_ratio_20": c / F.col("ma20") - 1, "ma_ratio_60": c / F.col("ma60") - 1, "ma20_ma60": F.col("ma20") / F.col("ma60") - 1, "ma5_ma20": F.col("ma5") / F.col("ma20") - 1,
        "channel_pos_60": F.when(F.count("close").over(back(60)) == 60, (c - lo) / F.nullif(hi - lo, F.lit(0.0))), "sump_20": F.when(full(20), F.sum("gain").over(back(20))), "roc_20": 100 * (c / F.lag("close", 20).over(w) - 1),
        "mfi_14": F.when(full(14), 100 * ups / F.nullif(ups + downs, F.lit(0.0))), "atr_pct": F.when(full(14), F.avg("tr").over(back(14)) / c),
    }
    d = d.withColumns(made).withColumns({x: F.expr(rounded(x, 9)) for x in FACTORS})
    d = d.select("symbol", "trade_date", "r_20", *FACTORS, P.bucket(F.col("total_mv"), P.CAP_BOUNDS).cast("string").alias("mv"), P.bucket(F.col("pe"), P.PE_BOUNDS).cast("string").alias("pe"), "industry")
    f = both.select("symbol", "trade_date", F.round(F.expr(MAIN), 2).alias("net"))
    three = w.rowsBetween(-2, 0)
    f = f.select("symbol", "trade_date", flow_state(F.col("net"), F.count("net").over(three), F.count(F.when(F.col("net") > 0, 1)).over(three), F.count(F.when(F.col("net") < 0, 1)).over(three)).alias("mf_state"))
    m = market(spark, sf_dir, bars).select("trade_date", trend_of(F.round(100 * (c / F.lag("close", 20).over(w) - 1), 9)).alias("trend"))
    held = kept(t(spark, sf_dir, "holdings").groupBy("symbol").agg(F.count(F.lit(1)).alias("funds")), "held")
    held = held.join(F.broadcast(held.agg(F.avg("funds").alias("usual")))).select("symbol", (F.col("funds") > F.col("usual")).alias("etf_held"))  # one row
    d = d.join(f, ["symbol", "trade_date"], "left").join(m, "trade_date", "left").join(held, "symbol", "left")
    return d.withColumn("etf_held", F.coalesce("etf_held", F.lit(False)))


def by_factor(d: DataFrame) -> DataFrame:
    x = F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in FACTORS)))
    return d.select(*(c for c in d.columns if c not in FACTORS), x.alias("x")).select("*", "x.*").drop("x")


def table_of(d: DataFrame) -> DataFrame:
    dims = F.explode(F.array(*(F.struct(F.lit(s).alias("dim"), F.col(s).alias("seg")) for s in layers.DIMS)))
    return layers.validity_table(d.select(F.col("name").alias("factor"), "value", F.col("r_20").alias("r"), dims.alias("x")).select("factor", "value", "r", "x.*"))


def score(spark, sf_dir) -> DataFrame:
    d = by_factor(kept(wide(spark, sf_dir), "wide"))
    return layers.layered_score(d, kept(table_of(d), "validity"))


_F = lambda n: f"({W_} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_MEAN = lambda n: f"CASE WHEN count(close) OVER {_F(n)} = {n} THEN avg(close) OVER {_F(n)} END AS ma{n}"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CTE = lambda name: f"{name} AS " + CTES[name].split(f"{name} AS ")[1]
_WIDE = f"""{lab('panel')},
x1 AS (SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER ({W_}) AS before, {_MEAN(5)}, {_MEAN(20)}, {_MEAN(60)} FROM lab),
x2 AS (SELECT *, lag(tp) OVER ({W_}) AS tp0, greatest(100 * (close / before - 1), 0.0) AS gain, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM x1),
x3 AS (SELECT *, coalesce(sum(CASE WHEN tp > tp0 THEN tp * vol END) OVER {_F(14)}, 0.0) AS ups, coalesce(sum(CASE WHEN tp < tp0 THEN tp * vol END) OVER {_F(14)}, 0.0) AS downs FROM x2),
x4 AS (SELECT symbol, trade_date, r_20, industry, CAST({bucket_sql('total_mv', P.CAP_BOUNDS)} AS VARCHAR) AS mv, CAST({bucket_sql('pe', P.PE_BOUNDS)} AS VARCHAR) AS pe, close / ma20 - 1 AS ma_ratio_20, close / ma60 - 1 AS ma_ratio_60, ma20 / ma60 - 1 AS ma20_ma60, ma5 / ma20 - 1 AS ma5_ma20,
 CASE WHEN count(close) OVER {_F(60)} = 60 THEN (close - min(low) OVER {_F(60)}) / nullif(max(high) OVER {_F(60)} - min(low) OVER {_F(60)}, 0) END AS channel_pos_60, CASE WHEN count(before) OVER {_F(20)} = 20 THEN sum(gain) OVER {_F(20)} END AS sump_20, 100 * (close / lag(close, 20) OVER ({W_}) - 1) AS roc_20,
 CASE WHEN count(before) OVER {_F(14)} = 14 THEN 100 * ups / nullif(ups + downs, 0) END AS mfi_14, CASE WHEN count(before) OVER {_F(14)} = 14 THEN avg(tr) OVER {_F(14)} / close END AS atr_pct FROM x3),
{_CTE('flow')}, {_CTE('holdings')},
fl AS (SELECT symbol, trade_date, round({MAIN}, 2) AS net FROM flow),
fs AS (SELECT symbol, trade_date, CASE WHEN min(net) OVER w > 0 AND count(*) OVER w = 3 THEN 'main_inflow_3d' WHEN max(net) OVER w < 0 AND count(*) OVER w = 3 THEN 'main_outflow_3d' WHEN net > 0 THEN 'main_inflow' WHEN count(*) OVER w = 3 THEN 'neutral' END AS mf_state FROM fl WINDOW w AS ({W_} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
mk AS (SELECT trade_date, round(100 * (close / lag(close, 20) OVER (ORDER BY trade_date) - 1), 9) AS r FROM (SELECT trade_date, round(avg(close), 8) AS close FROM bars GROUP BY trade_date)),
hd AS (SELECT symbol, count(*) AS funds FROM holdings GROUP BY symbol),
wd AS (SELECT x4.* EXCLUDE ({', '.join(FACTORS)}), {', '.join(f'{rounded(f, 9)} AS {f}' for f in FACTORS)}, mf_state, CASE WHEN mk.r > 0.5 THEN 'fast_bull' WHEN mk.r > 0 THEN 'slow_bull' WHEN mk.r < -0.5 THEN 'bear' ELSE 'sideways' END AS trend, coalesce(funds > (SELECT avg(funds) FROM hd), false) AS etf_held FROM x4 LEFT JOIN fs USING (symbol, trade_date) LEFT JOIN mk USING (trade_date) LEFT JOIN hd USING (symbol)),
lg AS (UNPIVOT (SELECT symbol, trade_date, r_20, industry, mv, pe, mf_state, trend, etf_held, {', '.join(FACTORS)} FROM wd) ON {', '.join(FACTORS)} INTO NAME name VALUE value),
dl AS (SELECT name, value, r_20 AS r, 'mv' AS dim, mv AS seg FROM lg UNION ALL SELECT name, value, r_20, 'industry', industry FROM lg UNION ALL SELECT name, value, r_20, 'pe', pe FROM lg),
th AS (SELECT name, dim, seg, list_transform(quantile_cont(value, [0.2, 0.4, 0.6, 0.8]), lambda x: round(x, 12)) AS th FROM dl WHERE r IS NOT NULL AND seg IS NOT NULL GROUP BY ALL),
ce AS (SELECT name, dim, seg, th, 1 + len(list_filter(th, lambda x: x <= value)) AS q, count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win FROM dl JOIN th USING (name, dim, seg) WHERE r IS NOT NULL GROUP BY ALL),
tb AS (SELECT name, dim, seg, any_value(th) AS th, max(CASE WHEN q = 3 AND n >= 20 THEN win END) AS q3, coalesce(max(CASE WHEN n >= 20 THEN win END) - max(CASE WHEN q = 3 AND n >= 20 THEN win END) >= 0.05, false) AS active FROM ce GROUP BY name, dim, seg),
lk AS (SELECT l.*, tb.dim, tb.seg, tb.active, tb.q3, 1 + len(list_filter(tb.th, lambda x: x <= l.value)) AS q FROM (SELECT * FROM lg WHERE name IN (SELECT name FROM tb)) l LEFT JOIN tb ON tb.name = l.name AND (tb.dim = 'mv' AND tb.seg = l.mv OR tb.dim = 'industry' AND tb.seg = l.industry OR tb.dim = 'pe' AND tb.seg = l.pe)),
ev AS (SELECT lk.*, win, win - q3 AS ex, abs(win - q3) >= 0.04 AS said, CASE lk.dim WHEN 'mv' THEN 1 WHEN 'industry' THEN 2 ELSE 3 END AS o FROM lk LEFT JOIN (SELECT * FROM ce WHERE n >= 20) c ON c.name = lk.name AND c.dim = lk.dim AND c.seg = lk.seg AND c.q = lk.q),
pf AS (SELECT symbol, trade_date, name, any_value(mv) AS mv, any_value(etf_held) AS etf_held, any_value(mf_state) AS mf_state, any_value(trend) AS trend, count(dim) AS dims, count(*) FILTER (said) AS n, count(*) FILTER (said AND ex > 0) AS ups, coalesce(bool_or(active) FILTER (said), false) AS lively, avg(ex) FILTER (said) AS ex, avg(win) FILTER (said) AS w_eff, avg(q3) FILTER (said) AS q3_eff, arg_min(q, o) FILTER (win IS NOT NULL AND q3 IS NOT NULL) AS q FROM ev GROUP BY symbol, trade_date, name),
mu AS (SELECT *, CASE WHEN name IN ({_LIST(layers.MOMENTUM)}) THEN CASE trend WHEN 'slow_bull' THEN 1.1 WHEN 'fast_bull' THEN 1.2 WHEN 'bear' THEN 0.8 ELSE 1.0 END WHEN name IN ({_LIST(layers.REVERSAL)}) THEN CASE trend WHEN 'slow_bull' THEN 0.9 WHEN 'fast_bull' THEN 0.8 WHEN 'bear' THEN 1.2 ELSE 1.0 END ELSE 1.0 END AS regime_mul,
 CASE WHEN etf_held AND mv IN ('3', '4') AND name IN ({_LIST(layers.MOMENTUM)}) THEN 1.3 WHEN etf_held AND mv IN ('0', '1') AND name IN ({_LIST(layers.REVERSAL)}) THEN 0.7 ELSE 1.0 END AS etf_mul FROM pf),
ga AS (SELECT *, ex * 30 * regime_mul * etf_mul AS raw, CASE WHEN mf_state IS NULL OR name NOT IN ({_LIST(layers.GATED)}) OR ex IS NULL OR ex = 0 THEN NULL WHEN ex > 0 THEN CASE WHEN mf_state IN ('main_inflow', 'main_inflow_3d') THEN 'mf_inflow_confirm' WHEN mf_state = 'main_outflow_3d' THEN 'mf_outflow_veto' ELSE 'mf_neutral' END WHEN mf_state = 'main_outflow_3d' THEN 'mf_outflow_confirm' ELSE 'mf_neutral' END AS gate FROM mu),
de AS (SELECT *, greatest(-8.0, least(8.0, CASE gate WHEN 'mf_outflow_veto' THEN 0.0 WHEN 'mf_neutral' THEN raw * 0.5 ELSE raw END)) AS after FROM ga),
re AS (SELECT *, CASE WHEN dims = 0 THEN 'no_segment' WHEN n = 0 THEN 'not_extreme' WHEN ups > 0 AND ups < n THEN 'dims_disagree' WHEN NOT lively THEN 'no_active_segment' WHEN abs(after) < 0.1 THEN 'too_small' END AS reason FROM de),
ac AS (SELECT *, round(after + 3e-9, 2) AS delta FROM re WHERE reason IS NULL),
cf AS (SELECT symbol, trade_date, least(1.0, round(sum(CASE WHEN a.delta * b.delta < 0 THEN abs(a.delta) * abs(b.delta) ELSE 0.0 END) / any_value(top * top) / count(*), 9)) AS conflict FROM ac a JOIN ac b USING (symbol, trade_date) JOIN (SELECT symbol, trade_date, max(abs(delta)) AS top FROM ac GROUP BY ALL) m USING (symbol, trade_date) WHERE a.name < b.name GROUP BY symbol, trade_date),
sm AS (SELECT symbol, trade_date, coalesce(round(sum(CASE WHEN reason IS NULL THEN round(after + 3e-9, 2) END), 9), 0) AS sum_delta, count(*) FILTER (reason IS NULL) AS n_active, count(reason) AS n_silent, coalesce(any_value(conflict), 0.0) AS k FROM re LEFT JOIN cf USING (symbol, trade_date) GROUP BY symbol, trade_date),
kw AS (SELECT *, CASE WHEN k > 0.45 THEN 0.6 WHEN k > 0.25 THEN 0.85 ELSE 1.0 END AS k_weight FROM sm),
sc AS (SELECT *, round(greatest(0.0, least(100.0, 50 + sum_delta * k_weight)) + 3e-9, 2) AS layered_score FROM kw)"""


@query(f"{_WIDE} SELECT symbol, trade_date, {{layered_score AS layered_score}}, CASE WHEN layered_score >= 65 THEN 'enter' WHEN layered_score >= 50 THEN 'hold' WHEN layered_score >= 35 THEN 'reduce' ELSE 'exit' END AS signal, {{round(sum_delta, 2) AS sum_delta}}, {{k_weight AS k_weight}}, {{round(k, 4) AS conflict}}, CASE WHEN n_active = 0 THEN 'none' WHEN n_active < 3 OR k > 0.45 THEN 'low' WHEN k > 0.25 THEN 'med' ELSE 'high' END AS confidence, n_active, n_silent FROM sc", "panel")
def sr10_layered_score(spark, sf_dir):
    """The score of every bar over nine factors and three kinds of segment."""
    return score(spark, sf_dir).drop("active", "silent")


@query(f"{_WIDE} SELECT symbol, trade_date, name, CAST(q AS INTEGER) AS q, {{round(w_eff, 4) AS w_eff}}, {{round(q3_eff, 4) AS q3_eff}}, {{delta AS delta}}, CASE WHEN ups > 0 THEN 1 ELSE -1 END AS sign, {{regime_mul AS regime_mul}}, {{etf_mul AS etf_mul}}, gate FROM ac", "panel")
def sr10_active_factors(spark, sf_dir):
    """What each active factor adds to a bar's score, and why."""
    return rows_of(score(spark, sf_dir).select("symbol", "trade_date", "active"), "active")


@query(f"{_WIDE} SELECT symbol, trade_date, name, reason FROM re WHERE reason IS NOT NULL", "panel")
def sr10_silent_factors(spark, sf_dir):
    """The factors that say nothing of a bar, and why."""
    return rows_of(score(spark, sf_dir).select("symbol", "trade_date", "silent"), "silent")
