"""Registered queries of decisions: quadrants, combinations of flow events, exits, anomalies against signals, capped selection, trend lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import channel
from .operators import panels as P
from .operators.features import FEATURES
from .panel_queries import FACTS, W_, facts, query, t
from .relation_queries import pivot_pairs
from .score_queries import POOLS, SCORED, _POOLED, pooled, scored
from .sources.fixtures import CTES

_SIGNALS, _BRANDS = CTES["signals"].split("signals AS ")[1], CTES["signals"].split("signals AS ")[0]


def quadrant(buy: Column, sell: Column) -> Column:
    """ideal, mixed, short, quiet or neutral by the two scores."""
    return F.when((buy >= 70) & (sell <= 30), "ideal").when((buy >= 70) & (sell >= 70), "mixed").when((buy <= 30) & (sell >= 70), "short").when((buy <= 30) & (sell <= 30), "quiet").otherwise("neutral")


@query(f"{SCORED}, s AS (SELECT symbol, trade_date, round(0.6 * trend + 0.4 * place_s, 9) AS buy, round(0.7 * (100 - volume) + 0.3 * value_s, 9) AS sell FROM scored) SELECT symbol, trade_date, CASE WHEN buy >= 70 AND sell <= 30 THEN 'ideal' WHEN buy >= 70 AND sell >= 70 THEN 'mixed' WHEN buy <= 30 AND sell >= 70 THEN 'short' WHEN buy <= 30 AND sell <= 30 THEN 'quiet' ELSE 'neutral' END AS quadrant FROM s", "panel")
def sr16_quadrants(spark, sf_dir):
    """Blended buy and sell scores and their quadrant."""
    d = scored(spark, sf_dir)
    buy, sell = F.round(0.6 * F.col("trend") + 0.4 * F.col("place_s"), 9), F.round(0.7 * (100 - F.col("volume")) + 0.3 * F.col("value_s"), 9)
    return d.select("symbol", "trade_date", quadrant(buy, sell).alias("quadrant"))


_EVENTS = FEATURES["w29_flow_events"]()
_CTES, _LAST = _EVENTS.sql("panel_flow").rsplit("\nSELECT ", 1)


@query(f"{_CTES}, ev AS (SELECT {_LAST}), f AS (SELECT symbol, trade_date, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3, coalesce(f6, 1) AS f6, coalesce(f7, 0) AS f7, coalesce(f8, 0) AS f8 FROM ev) SELECT symbol, trade_date, {{f1 - f2 AS net_event_money}}, {{f7 - f8 AS silent_balance}}, {{f1 - f2 + 0.3 * (f7 - f8) AS event_silent}}, {{abs(f1) + abs(f2) AS intensity}}, {{f1 / (abs(f1) + abs(f2) + 0.001) AS accumulation}}, {{f3 * sign(f1) AS breakout_smart}}, {{(f6 - 1) * sign(f1 - f2) AS misalign}} FROM f", "panel_flow")
def sr23_seven_combinations(spark, sf_dir):
    """Seven combinations of the flow events, missing events as 0 (pressure as 1)."""
    d = _EVENTS.apply(t(spark, sf_dir, "panel_flow"))
    f = {k: F.coalesce(f"f{k}", F.lit(1.0 if k == 6 else 0.0)) for k in (1, 2, 3, 6, 7, 8)}
    net, silent, size = f[1] - f[2], f[7] - f[8], F.abs(f[1]) + F.abs(f[2])
    out = {"net_event_money": net, "silent_balance": silent, "event_silent": net + 0.3 * silent, "intensity": size, "accumulation": f[1] / (size + 0.001), "breakout_smart": f[3] * F.signum(f[1]), "misalign": (f[6] - 1) * F.signum(net)}
    return d.select("symbol", "trade_date", *(x.alias(c) for c, x in out.items()))


#: Rows that a pool's positions are held.
HOLDING = {
    "pool1_v7c_main": 20, "pool2_triple_consensus": 45, "pool3_oversold_rebound": 8, "pool4_bottom_breakout": 30, "pool5_policy_wave": 15, "pool6_strong_pullback": 12,
    "pool7_pyramid_strong": 15, "pool8_pullback_long": 20, "pool9_pulse_short": 5,
}


def exit_rule(held: Column, ret: Column, pred: Column, zombie: Column, size: Column, target: Column, limit: Column, stop: float = -8.0) -> Column:
    """exit_all, reduce_half, reduce_to_regime or hold: time, stop, four fifths of the prediction, zombie, regime; the first that holds."""
    return F.when(held >= limit, "exit_all").when(ret <= stop, "exit_all").when((pred > 0) & (ret >= 0.8 * pred), "reduce_half").when(zombie, "reduce_half").when(size > target * 1.2, "reduce_to_regime").otherwise("hold")


_MAP = lambda m: " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items())


@query(f"{_POOLED}, h AS (SELECT *, lag(pool, 14) OVER ({W_}) AS entry_pool, lag(close, 14) OVER ({W_}) AS entry_price, lag(r20_pred, 14) OVER ({W_}) AS pred FROM p), x AS (SELECT *, 100 * (close / entry_price - 1) AS ret, CASE entry_pool {_MAP(HOLDING)} END AS lim, CASE entry_pool {_MAP(POOLS)} END AS base FROM h WHERE entry_pool IS NOT NULL) SELECT symbol, trade_date, entry_pool, CASE WHEN 14 >= lim OR ret <= -1.5 THEN 'exit_all' WHEN pred > 0 AND ret >= 0.8 * pred OR is_zombie THEN 'reduce_half' WHEN base > base * (CASE WHEN trend < 40 THEN 0.5 ELSE 0.9 END) * 1.2 THEN 'reduce_to_regime' ELSE 'hold' END AS action FROM x", "panel")
def sr19_exit_rules(spark, sf_dir):
    """Positions opened 14 rows before in the pool of then, held against the rules; the stop is cut to the fixture's small moves."""
    w = P.by_time()
    by = lambda m: F.try_element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col("entry_pool"))
    d = pooled(spark, sf_dir).withColumns({"entry_pool": F.lag("pool", 14).over(w), "entry_price": F.lag("close", 14).over(w), "pred": F.lag("r20_pred", 14).over(w)}).where("entry_pool IS NOT NULL")
    ret, base = 100 * (F.col("close") / F.col("entry_price") - 1), by(POOLS)
    action = exit_rule(F.lit(14), ret, F.col("pred"), F.col("is_zombie"), base, base * F.when(F.col("trend") < 40, 0.5).otherwise(0.9), by(HOLDING), stop=-1.5)
    return d.select("symbol", "trade_date", "entry_pool", action.alias("action"))


def anomaly(score: Column, pct: Column, buy_min: float = 60.0, sell_max: float = 45.0, severe: float = 3.0, warn: float = 1.5) -> Column:
    """A buy that falls or a sell that rises, by how far."""
    against = F.when(score >= buy_min, -pct).when(score < sell_max, pct)
    return F.when(against >= severe, "severe").when(against >= warn, "warning").otherwise("normal")


@query(f"{_BRANDS}signals AS {_SIGNALS}, n AS (SELECT symbol, trade_date, 100 * (lead(close) OVER ({W_}) / close - 1) AS pct FROM bars) SELECT o_orderkey, symbol, {{score AS score}}, {{pct AS pct}}, CASE WHEN score >= 60 AND pct <= -3 OR score < 45 AND pct >= 3 THEN 'severe' WHEN score >= 60 AND pct <= -1.5 OR score < 45 AND pct >= 1.5 THEN 'warning' ELSE 'normal' END AS level FROM signals JOIN n USING (symbol, trade_date) WHERE pct IS NOT NULL")
def d15_signal_anomalies(spark, sf_dir):
    """Signals and the next bar's change: does it go against what the signal's side expects."""
    n = t(spark, sf_dir, "bars").select("symbol", "trade_date", (100 * (F.lead("close").over(P.by_time()) / F.col("close") - 1)).alias("pct")).where("pct IS NOT NULL")
    d = t(spark, sf_dir, "signals").join(n, ["symbol", "trade_date"])
    return d.select("o_orderkey", "symbol", "score", "pct", anomaly(F.col("score"), F.col("pct")).alias("level"))


@query(f"{FACTS}, g AS (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY bias DESC NULLS LAST, symbol) AS k FROM facts), o AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY bias DESC NULLS LAST, symbol) AS rank FROM g WHERE k <= 2) SELECT trade_date, symbol, industry, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 8", "panel")
def rk08_diversified_target(spark, sf_dir):
    """A target of eight a date, at most max(2, a quarter of the target) of one industry, by score."""
    target, cap = 8, 0.25
    most = max(2, int(target * cap))
    per = Window.partitionBy("trade_date", "industry").orderBy(F.col("bias").desc_nulls_last(), "symbol")
    d = facts(spark, sf_dir).withColumn("k", F.row_number().over(per)).where(F.col("k") <= most)
    return P.top_n(d, ["trade_date"], "bias", target).select("trade_date", "symbol", "industry", "rank")


_LINES = f"n AS (SELECT symbol, CAST(row_number() OVER ({W_}) AS INTEGER) AS i, low, close, min(low) OVER ({W_} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l7, count(*) OVER (PARTITION BY symbol) AS n FROM bars), pv AS (SELECT symbol, i, low, n FROM n WHERE low = l7 AND i > n - 120), pr AS (SELECT a.symbol, a.i, b.i AS j, a.low AS a, (b.low - a.low) / (b.i - a.i) AS s FROM pv a JOIN pv b ON a.symbol = b.symbol AND b.i - a.i BETWEEN 8 AND 60), tc AS (SELECT pr.symbol, pr.i, pr.j, any_value(pr.a) AS a, any_value(pr.s) AS s, count(*) AS touches FROM pr JOIN pv ON pv.symbol = pr.symbol AND pv.i >= pr.i AND abs(round(pv.low / (pr.a + pr.s * (pv.i - pr.i)) - 1, 9)) <= 0.002 GROUP BY pr.symbol, pr.i, pr.j), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY touches DESC, j - i DESC, i DESC) AS k FROM tc)"


@query(f"{_LINES}, e AS (SELECT symbol, arg_max(close, i) AS close, max(i) AS last FROM n GROUP BY symbol) SELECT b.symbol, b.i, b.j, touches, {{s AS slope}}, {{a + s * (last - b.i) AS level}}, round(close - (a + s * (last - b.i)), 9) < 0 AS broken FROM b JOIN e USING (symbol) WHERE k = 1")
def d07_trend_lines(spark, sf_dir):
    """The support line through two lows of a symbol's last 120 rows that most lows touch (within 0.2 %), where it stands now, and whether the last close is under it."""
    w = P.by_time()
    whole = Window.partitionBy("symbol")
    n = t(spark, sf_dir, "bars").select("symbol", "low", "close", F.row_number().over(w).alias("i"), F.min("low").over(w.rowsBetween(-3, 3)).alias("l7"), F.count(F.lit(1)).over(whole).alias("n"))
    points = n.where("low = l7 AND i > n - 120").select("symbol", "i", "low")
    pairs = pivot_pairs(points, "low", 8, 60).withColumn("slope", (F.col("b") - F.col("a")) / (F.col("j") - F.col("i")))
    seen = points.select(F.col("symbol").alias("s"), F.col("i").alias("at"), F.col("low").alias("y"))
    line = F.col("a") + F.col("slope") * (F.col("at") - F.col("i"))
    hits = pairs.join(seen, (F.col("symbol") == F.col("s")) & (F.col("at") >= F.col("i"))).where(F.abs(F.round(F.col("y") / line - 1, 9)) <= 0.002)
    counted = hits.groupBy("symbol", "i", "j", "a", "slope").agg(F.count(F.lit(1)).alias("touches"))
    best = counted.withColumn("k", F.row_number().over(whole.orderBy(F.desc("touches"), (F.col("j") - F.col("i")).desc(), F.desc("i")))).where("k = 1")
    end = n.groupBy("symbol").agg(F.max_by("close", "i").alias("close"), F.max("i").alias("last"))
    level = F.col("a") + F.col("slope") * (F.col("last") - F.col("i"))
    return best.join(end, "symbol").select("symbol", "i", "j", "touches", "slope", level.alias("level"), (F.round(F.col("close") - level, 9) < 0).alias("broken"))


@query("")
def d10_eight_phases(spark, sf_dir):
    """Phase, rows in it and score of every bar against its channel."""
    return channel.phases(channel.inputs().apply(t(spark, sf_dir, "bars"))).select("symbol", "trade_date", "phase", "days", "score")


@query("")
def d11_phase_profile(spark, sf_dir):
    """Count, mean, median and win rate by phase over 5, 10 and 20 rows."""
    labels = P.forward(t(spark, sf_dir, "bars"), (5, 10, 20), entry="close").select("symbol", "trade_date", "r_5", "r_10", "r_20")
    d = channel.phases(channel.inputs().apply(t(spark, sf_dir, "bars"))).where("phase IS NOT NULL").join(labels, ["symbol", "trade_date"])
    rows = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"r_{h}").alias("r")) for h in (5, 10, 20)))
    return d.select("phase", F.explode(rows).alias("x")).select("phase", "x.*").groupBy("phase", "horizon").agg(*P.outcome("r"))


# Layered scores ------------------------------------------------------------------------------------------------

_LONG = "SELECT symbol, trade_date, cap, industry, value, trend, r_20, f.factor, CAST(floor(f.x * 5) AS INTEGER) AS q FROM (SELECT *, unnest([{'factor': 'bias', 'x': least(0.999, greatest(0.0, (bias + 0.03) / 0.06))}, {'factor': 'place', 'x': least(0.999, coalesce(place, 0.5))}, {'factor': 'surge', 'x': least(surge / 3, 0.999)}]) AS f FROM scored)"
_CELL = " UNION ALL ".join(f"SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS seg, factor, q, avg(r_20) AS m, count(r_20) AS n FROM long GROUP BY ALL" for d in ("cap", "industry", "value"))
_LAYERS = f"{SCORED}, long AS ({_LONG}), cells AS ({_CELL}), ex AS (SELECT c.dim, c.seg, c.factor, c.q, c.m - b.m AS ex FROM cells c JOIN cells b ON b.dim = c.dim AND b.seg = c.seg AND b.factor = c.factor AND b.q = 2 WHERE c.n >= 20 AND b.n >= 20), lk AS (SELECT symbol, trade_date, trend, factor, q, d.dim, d.seg FROM (SELECT *, unnest([{{'dim': 'cap', 'seg': CAST(cap AS VARCHAR)}}, {{'dim': 'industry', 'seg': industry}}, {{'dim': 'value', 'seg': CAST(value AS VARCHAR)}}]) AS d FROM long)), a AS (SELECT symbol, trade_date, any_value(trend) AS trend, factor, avg(ex) AS ex, count(*) AS dims, min(round(ex, 9)) * max(round(ex, 9)) >= 0 AS agree FROM lk JOIN ex USING (dim, seg, factor, q) GROUP BY symbol, trade_date, factor), pt AS (SELECT symbol, trade_date, factor, dims, CASE WHEN abs(round(ex, 9)) < 0.05 THEN 0.0 ELSE greatest(-20.0, least(20.0, 10 * ex)) * (CASE WHEN agree THEN 1.0 ELSE 0.5 END) * (CASE WHEN trend > 55 AND ex > 0 OR trend < 45 AND ex < 0 THEN 1.1 ELSE 0.9 END) END AS p FROM a)"


def layered(spark, sf_dir) -> DataFrame:
    """(symbol, trade_date, factor, dims, p): a factor's points from its bin's excess over the middle bin in three kinds of segment; halved if they disagree, moved by the market's side, none if small."""
    c = F.col
    d = scored(spark, sf_dir)
    x = {"bias": F.least(F.lit(0.999), F.greatest(F.lit(0.0), (c("bias") + 0.03) / 0.06)), "place": F.least(F.lit(0.999), F.coalesce("place", F.lit(0.5))), "surge": F.least(c("surge") / 3, F.lit(0.999))}
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), F.floor(v * 5).cast("int").alias("q")) for k, v in x.items())))
    segments = F.explode(F.array(*(F.struct(F.lit(s).alias("dim"), c(s).cast("string").alias("seg")) for s in ("cap", "industry", "value"))))
    long = d.select("symbol", "trade_date", "trend", "r_20", "cap", "industry", "value", values.alias("f")).select("*", "f.*", segments.alias("d")).select("symbol", "trade_date", "trend", "r_20", "factor", "q", "d.*")
    keys = ["dim", "seg", "factor"]
    cells = long.groupBy(*keys, "q").agg(F.avg("r_20").alias("m"), F.count("r_20").alias("n")).where("n >= 20")
    middle = F.max(F.when(c("q") == 2, c("m"))).over(Window.partitionBy(*keys))
    cells = cells.withColumn("ex", c("m") - middle).where("ex IS NOT NULL").select(*keys, "q", "ex")
    a = long.join(cells, [*keys, "q"]).groupBy("symbol", "trade_date", "factor").agg(F.max("trend").alias("trend"), F.avg("ex").alias("ex"), F.count(F.lit(1)).alias("dims"), (F.min(F.round("ex", 9)) * F.max(F.round("ex", 9)) >= 0).alias("agree"))
    ex = c("ex")
    moved = F.when(((c("trend") > 55) & (ex > 0)) | ((c("trend") < 45) & (ex < 0)), 1.1).otherwise(0.9)
    p = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), 10 * ex)) * F.when(c("agree"), 1.0).otherwise(0.5) * moved
    return a.select("symbol", "trade_date", "factor", "dims", F.when(F.abs(F.round(ex, 9)) < 0.05, 0.0).otherwise(p).alias("p"))


@query(f"{_LAYERS} SELECT symbol, trade_date, {{greatest(0.0, least(100.0, 50 + sum(p))) AS score}}, {{sum(greatest(p, 0.0)) * sum(greatest(-p, 0.0)) - sum(greatest(p, 0.0) * greatest(-p, 0.0)) AS conflict}}, {{abs(sum(p)) / (sum(abs(p)) + 1e-6) AS confidence}}, count(CASE WHEN abs(p) > 0 THEN 1 END) AS active FROM pt GROUP BY symbol, trade_date", "panel")
def sr10_three_layers(spark, sf_dir):
    """Score, conflict, confidence and active factors of every bar over three kinds of segment."""
    p, zero = F.col("p"), F.lit(0.0)
    up, down = F.greatest(p, zero), F.greatest(-p, zero)
    g = layered(spark, sf_dir).groupBy("symbol", "trade_date")
    return g.agg(F.greatest(zero, F.least(F.lit(100.0), 50 + F.sum(p))).alias("score"), (F.sum(up) * F.sum(down) - F.sum(up * down)).alias("conflict"), (F.abs(F.sum(p)) / (F.sum(F.abs(p)) + 1e-6)).alias("confidence"), F.count_if(F.abs(p) > 0).alias("active"))


@query(f"{_LAYERS}, d AS (SELECT *, round(p, 2) AS r FROM pt WHERE trade_date = DATE '1997-03-03' AND abs(p) > 0) SELECT symbol, string_agg(factor || (CASE WHEN r > 0 THEN '+' ELSE '-' END), ',' ORDER BY abs(r) DESC, factor) AS evidence, {{sum(p) AS points}} FROM d GROUP BY symbol", "panel")
def sr11_evidence(spark, sf_dir):
    """The active factors of a date's symbols, the weightiest first, with their side."""
    d = layered(spark, sf_dir).where("trade_date = DATE '1997-03-03' AND abs(p) > 0").withColumn("r", F.round("p", 2))
    rows = F.array_sort(F.collect_list(F.struct((-F.abs("r")).alias("o"), "factor", "r")))
    shown = F.transform(rows, lambda x: F.concat(x["factor"], F.when(x["r"] > 0, "+").otherwise("-")))
    return d.groupBy("symbol").agg(F.array_join(shown, ",").alias("evidence"), F.sum("p").alias("points"))


@query(f"{_LAYERS}, s1 AS (SELECT factor, p FROM pt WHERE trade_date = DATE '1997-03-03' AND symbol = 'Brand#1'), s2 AS (SELECT factor, p FROM pt WHERE trade_date = DATE '1997-03-03' AND symbol = 'Brand#2') SELECT coalesce(s1.factor, s2.factor) AS factor, {{s1.p AS first}}, {{s2.p AS second}}, {{coalesce(s1.p, 0) - coalesce(s2.p, 0) AS difference}} FROM s1 FULL JOIN s2 ON s1.factor = s2.factor", "panel")
def sr11_comparison(spark, sf_dir):
    """Two symbols' factors side by side."""
    d = layered(spark, sf_dir).where("trade_date = DATE '1997-03-03'")
    one = lambda s, c: d.where(F.col("symbol") == s).select("factor", F.col("p").alias(c))
    both = one("Brand#1", "first").join(one("Brand#2", "second"), "factor", "full")
    return both.withColumn("difference", F.coalesce("first", F.lit(0.0)) - F.coalesce("second", F.lit(0.0)))
