"""Registered queries of composite scores, pools, sizes, evaluation of scores, further labels and portfolios; the SQL beside each is written by itself."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import panels as P
from .operators.spec import rounded
from .panel_queries import FACTS, STATS, W_, facts, query, t
from .sources.fixtures import CTES

_HELD = CTES["holdings"].split(",\nholdings AS ")[1]
_SIGNALS = CTES["signals"].split(",\nsignals AS ")[1]


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


#: Four dimension scores of a bar, 0 to 100, and what the scoring rules read: predictions, policy heat, zombie share.
_DIM = {
    "trend": "least(100.0, greatest(0.0, 50 + 1500 * bias))", "place_s": "100 * coalesce(place, 0.5)", "volume": "least(100.0, 50 * surge)", "value_s": "least(100.0, greatest(0.0, 100.0 - pe))",
    "r20_pred": "400 * bias", "r10_pred": "250 * bias", "heat": "least(100.0, 60 * surge)",
}
SCORED = f"{FACTS}, dimensions AS (SELECT *, {', '.join(f'{rounded(x, 9)} AS {c}' for c, x in _DIM.items())} FROM facts), scored AS (SELECT *, {rounded(f'avg(CASE WHEN abs(bias) < 0.006 THEN 1.0 ELSE 0.0 END) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 9)} AS zombie_days, {rounded(f'close / avg(close) OVER ({W_} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1', 9)} AS slope60, {rounded(f'100 * (close / lag(close, 20) OVER ({W_}) - 1)', 9)} AS ret_20, {rounded(f'100 * (close / lag(close, 5) OVER ({W_}) - 1)', 9)} AS ret_5, {rounded(f'100 * (close / lag(close, 60) OVER ({W_}) - 1)', 9)} AS ret_60 FROM dimensions)"


def scored(spark, sf_dir) -> DataFrame:
    w = P.by_time()
    back = lambda n: 100 * (F.col("close") / F.lag("close", n).over(w) - 1)
    d = facts(spark, sf_dir)
    cut = lambda c: F.expr(rounded(c, 9))
    made = {
        "trend": clip(50 + 1500 * F.col("bias"), 0.0, 100.0), "place_s": 100 * F.coalesce("place", F.lit(0.5)), "volume": F.least(F.lit(100.0), 50 * F.col("surge")), "value_s": clip(100.0 - F.col("pe"), 0.0, 100.0),
        "r20_pred": 400 * F.col("bias"), "r10_pred": 250 * F.col("bias"), "heat": F.least(F.lit(100.0), 60 * F.col("surge")),
        "zombie_days": F.avg(F.when(F.abs("bias") < 0.006, 1.0).otherwise(0.0)).over(w.rowsBetween(-19, 0)), "slope60": F.col("close") / F.avg("close").over(w.rowsBetween(-59, 0)) - 1,
        "ret_20": back(20), "ret_5": back(5), "ret_60": back(60),
    }
    return d.withColumns(made).withColumns({c: cut(c) for c in made})


# Composite scores ------------------------------------------------------------------------------------------

#: Weights of the dimensions, pulls of the key ones, the noisy ones, the trend ones, the neutral zone.
WEIGHTS = {"trend": 0.4, "place_s": 0.3, "volume": 0.2, "value_s": 0.1}
PULLS = {"trend": 0.1, "volume": 0.05}
NOISY, ZONE, STRETCH = ("value_s",), 3.0, 2.5


def pull(scores: dict[str, Column]) -> Column:
    """What key dimensions above 75 or below 25 add."""
    return sum((F.when(s > 75, (s - 75) * PULLS[d]).when(s < 25, -(25 - s) * PULLS[d]).otherwise(0.0) for d, s in scores.items() if d in PULLS), F.lit(0.0))


def composite_b(scores: dict[str, Column]) -> Column:
    """Without noisy dimensions, weights made to sum to 1, stretched around 50."""
    kept = {d: s for d, s in scores.items() if d not in NOISY}
    total = sum(WEIGHTS[d] for d in kept)
    raw = sum((s * (WEIGHTS[d] / total) for d, s in kept.items()), F.lit(0.0))
    return clip(50.0 + (raw + pull(kept) - 50.0) * STRETCH, 0.0, 100.0)


def composite_c(scores: dict[str, Column]) -> Column:
    """Only dimensions outside the neutral zone count, their weights made to sum to 1; none: 50."""
    active = {d: F.when(F.abs(s - 50.0) > ZONE, WEIGHTS[d]).otherwise(0.0) for d, s in scores.items()}
    total = sum(active.values(), F.lit(0.0))
    raw = sum((s * active[d] for d, s in scores.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    return F.when(total == 0, 50.0).otherwise(clip(raw + pull(scores), 0.0, 100.0))


def composite_static(scores: dict[str, Column]) -> Column:
    return sum((s * WEIGHTS[d] for d, s in scores.items()), F.lit(0.0))


DIMS = tuple(WEIGHTS)


def dims() -> dict[str, Column]:
    return {d: F.col(d) for d in DIMS}


_PULL = "(CASE WHEN trend > 75 THEN (trend - 75) * 0.1 WHEN trend < 25 THEN -(25 - trend) * 0.1 ELSE 0.0 END + CASE WHEN volume > 75 THEN (volume - 75) * 0.05 WHEN volume < 25 THEN -(25 - volume) * 0.05 ELSE 0.0 END)"


@query(f"{SCORED} SELECT symbol, trade_date, {{greatest(0.0, least(100.0, 50 + ((trend * 0.4 + place_s * 0.3 + volume * 0.2) / 0.9 + {_PULL} - 50) * 2.5)) AS score}} FROM scored", "panel")
def sr04_composite_b(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "trade_date", composite_b(dims()).alias("score"))


_ACTIVE = {d: f"(CASE WHEN abs({d} - 50) > 3 THEN {w} ELSE 0.0 END)" for d, w in (("trend", 0.4), ("place_s", 0.3), ("volume", 0.2), ("value_s", 0.1))}


@query(f"{SCORED}, a AS (SELECT *, {' + '.join(_ACTIVE.values())} AS tw, {' + '.join(f'{d} * {w}' for d, w in _ACTIVE.items())} AS ts FROM scored) SELECT symbol, trade_date, {{CASE WHEN tw = 0 THEN 50.0 ELSE greatest(0.0, least(100.0, ts / tw + {_PULL})) END AS score}} FROM a", "panel")
def sr05_composite_c(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "trade_date", composite_c(dims()).alias("score"))


def own_percentile(x: str, rows: int = 120, least: int = 10) -> Column:
    """Share (0 to 100) of the last `rows` values, this one among them, that are below it; 50 with fewer than `least`."""
    last = F.collect_list(x).over(P.by_time().rowsBetween(-(rows - 1), 0))
    return F.when(F.size(last) < least, 50.0).otherwise(100.0 * F.size(F.filter(last, lambda y: y < F.col(x))) / F.size(last))


@query(f"{SCORED}, n AS (SELECT *, row_number() OVER ({W_}) AS i FROM scored), p AS (SELECT a.symbol, a.trade_date, {', '.join(f'CASE WHEN count(*) >= 10 THEN 100.0 * count(CASE WHEN b.{d} < a.{d} THEN 1 END) / count(*) ELSE 50.0 END AS {d}' for d in ('trend', 'place_s', 'volume', 'value_s'))} FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 119 AND a.i GROUP BY a.symbol, a.trade_date) SELECT symbol, trade_date, {{greatest(0.0, least(100.0, trend * 0.4 + place_s * 0.3 + volume * 0.2 + value_s * 0.1 + {_PULL})) AS score}} FROM p", "panel")
def sr06_composite_d(spark, sf_dir):
    """Every dimension replaced by its percentile in the symbol's own last 120 rows."""
    d = scored(spark, sf_dir).select("symbol", "trade_date", *(own_percentile(c).alias(c) for c in DIMS))
    return d.select("symbol", "trade_date", clip(composite_static(dims()) + pull(dims()), 0.0, 100.0).alias("score"))


_MARKET_ADJ = "(CASE WHEN m >= 65 THEN least(5.0, (m - 65) * 0.15) WHEN m <= 35 THEN -least(5.0, (35 - m) * 0.15) ELSE 0.0 END)"


@query(f"{SCORED}, v AS (SELECT *, round(avg(trend) OVER (PARTITION BY trade_date), 9) AS m, trend * 0.4 + place_s * 0.3 + volume * 0.2 + value_s * 0.1 AS fixed FROM scored), x AS (SELECT *, CASE WHEN m >= 50 THEN trend * 0.6 + place_s * 0.2 + volume * 0.2 ELSE place_s * 0.5 + value_s * 0.5 END AS dynamic FROM v) SELECT variant, count(r_20) AS n, {{avg(score) AS mean}}, {{corr(score, r_20) AS ic}} FROM (SELECT 'static' AS variant, fixed AS score, r_20 FROM x UNION ALL SELECT 'dynamic', dynamic, r_20 FROM x UNION ALL SELECT 'adjusted', greatest(0.0, least(100.0, fixed + {_MARKET_ADJ})), r_20 FROM x) WHERE r_20 IS NOT NULL GROUP BY variant", "panel")
def sr07_weight_variants(spark, sf_dir):
    """Static weights, weights that follow the market's mean trend, and static ones with the market's adjustment, against the next return."""
    d = scored(spark, sf_dir).withColumn("m", F.round(F.avg("trend").over(Window.partitionBy("trade_date")), 9))
    c = dims()
    dynamic = F.when(F.col("m") >= 50, c["trend"] * 0.6 + c["place_s"] * 0.2 + c["volume"] * 0.2).otherwise(c["place_s"] * 0.5 + c["value_s"] * 0.5)
    adjusted = clip(composite_static(c) + market_part(F.col("m")), 0.0, 100.0)
    variants = F.array(*(F.struct(F.lit(n).alias("variant"), s.alias("score")) for n, s in (("static", composite_static(c)), ("dynamic", dynamic), ("adjusted", adjusted))))
    long = d.where("r_20 IS NOT NULL").select("r_20", F.explode(variants).alias("v")).select("v.*", "r_20")
    return long.groupBy("variant").agg(F.count("r_20").alias("n"), F.avg("score").alias("mean"), P.correlation("score", "r_20").alias("ic"))


def damped(trend: Column, divergence: Column) -> Column:
    """A divergence outside 42 to 58 draws a strong (weak) trend back towards 50, by 70 % at most."""
    down, up = F.least(F.lit(0.7), (42 - divergence) / 50.0), F.least(F.lit(0.7), (divergence - 58) / 50.0)
    return F.when((divergence < 42) & (trend > 60), trend - (trend - 50) * down).when((divergence > 58) & (trend < 40), trend + (50 - trend) * up).otherwise(trend)


def consensus_weight(base: float, sigma: Column, n: Column) -> Column:
    """An agent's weight by how far its providers agree; with fewer than two, the base weight."""
    return F.when(n < 2, base).otherwise(clip(base * clip(1.0 - (sigma - 3.0) / 15.0, 0.5, 1.2), 0.15, 0.5))


@query(f"{SCORED}, d AS (SELECT *, 100 - place_s AS dv FROM scored) SELECT symbol, trade_date, {{CASE WHEN dv < 42 AND trend > 60 THEN trend - (trend - 50) * least(0.7, (42 - dv) / 50) WHEN dv > 58 AND trend < 40 THEN trend + (50 - trend) * least(0.7, (dv - 58) / 50) ELSE trend END AS trend}}, {{least(0.5, greatest(0.15, 0.35 * least(1.2, greatest(0.5, 1 - (list_stddev_pop([trend, place_s, volume]) - 3) / 15)))) AS weight}} FROM d", "panel")
def sr09_cross_factor(spark, sf_dir):
    d = scored(spark, sf_dir)
    three = [F.col(c) for c in ("trend", "place_s", "volume")]
    m = sum(three[1:], three[0]) / 3
    sigma = F.sqrt(sum(((x - m) * (x - m) for x in three), F.lit(0.0)) / 3)
    return d.select("symbol", "trade_date", damped(F.col("trend"), 100 - F.col("place_s")).alias("trend"), consensus_weight(0.35, sigma, F.lit(3)).alias("weight"))


# Market, quadrants, pools, sizes ---------------------------------------------------------------------------

#: Scores of trend states.
STATE_SCORES = {"uptrend": 80.0, "uptrend_breakdown": 55.0, "downtrend_breakout": 65.0, "sideways": 50.0, "trend_center": 48.0, "ma_convergence": 50.0, "downtrend": 20.0}


def trend_state(c: Column, ma5: Column, ma20: Column, ma60: Column, slope: Column, spread: Column, band: Column) -> Column:
    """Seven states of a series beside its means; the first rule that holds names the state."""
    near = (F.abs(c - ma20) / ma20 * 100) < 1.0
    up, down = (c > ma20) & (ma20 > ma60) & (slope > 0.05), (c < ma20) & (ma20 < ma60) & (slope < -0.05)
    return (
        F.when(spread < 2.0, "ma_convergence").when(up & (c < ma5) & near, "uptrend_breakdown").when(up, "uptrend").when(down & (c > ma5) & near, "downtrend_breakout").when(down, "downtrend")
        .when((band < 6.0) & (F.abs(slope) < 0.15), "sideways").when(F.abs(c - ma60) / ma60 * 100 < 3.0, "trend_center").when((ma20 > ma60) & (c < ma20), "uptrend_breakdown").when((ma20 < ma60) & (c > ma20), "downtrend_breakout").otherwise("sideways")
    )


_MAS = ", ".join(f"round(avg(close) OVER ({W_} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 9) AS ma{n}" for n in (5, 10, 20, 60))
STATES = f"ma AS (SELECT *, {_MAS}, round(400 * stddev_samp(close) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / avg(close) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS band, row_number() OVER ({W_}) AS i FROM bars), sl AS (SELECT *, round(100 * (ma20 / lag(ma20, 5) OVER ({W_}) - 1), 9) AS slope, round(100 * (greatest(ma5, ma10, ma20, ma60) / least(ma5, ma10, ma20, ma60) - 1), 9) AS spread, round(100 * (close / lag(close, 20) OVER ({W_}) - 1), 9) AS ret20 FROM ma), st AS (SELECT *, CASE WHEN spread < 0.5 THEN 'ma_convergence' WHEN close > ma20 AND ma20 > ma60 AND slope > 0.05 THEN CASE WHEN close < ma5 AND abs(close - ma20) / ma20 * 100 < 1 THEN 'uptrend_breakdown' ELSE 'uptrend' END WHEN close < ma20 AND ma20 < ma60 AND slope < -0.05 THEN CASE WHEN close > ma5 AND abs(close - ma20) / ma20 * 100 < 1 THEN 'downtrend_breakout' ELSE 'downtrend' END WHEN band < 6 AND abs(slope) < 0.15 THEN 'sideways' WHEN abs(close - ma60) / ma60 * 100 < 0.5 THEN 'trend_center' WHEN ma20 > ma60 AND close < ma20 THEN 'uptrend_breakdown' WHEN ma20 < ma60 AND close > ma20 THEN 'downtrend_breakout' ELSE 'sideways' END AS state FROM sl WHERE i > 60)"


def states(spark, sf_dir, close_spread: float = 0.5, centre: float = 0.5) -> DataFrame:
    """Trend states of bars; the two widths are cut to the fixture's small moves, the rules stay."""
    w = P.by_time()
    mean = lambda n: F.round(F.avg("close").over(w.rowsBetween(-(n - 1), 0)), 9)
    d = t(spark, sf_dir, "bars").withColumns({f"ma{n}": mean(n) for n in (5, 10, 20, 60)} | {"band": F.round(400 * F.stddev_samp("close").over(w.rowsBetween(-19, 0)) / F.avg("close").over(w.rowsBetween(-19, 0)), 9), "i": F.row_number().over(w)})
    four = [F.col(f"ma{n}") for n in (5, 10, 20, 60)]
    d = d.withColumns({"slope": F.round(100 * (F.col("ma20") / F.lag("ma20", 5).over(w) - 1), 9), "spread": F.round(100 * (F.greatest(*four) / F.least(*four) - 1), 9), "ret20": F.round(100 * (F.col("close") / F.lag("close", 20).over(w) - 1), 9)}).where("i > 60")
    c, ma60 = F.col("close"), F.col("ma60")
    # The rules' widths of 2 and 3 % are scaled by moving the inputs, so that the rules themselves stay as they are.
    state = trend_state(c, F.col("ma5"), F.col("ma20"), ma60, F.col("slope"), F.col("spread") * (2.0 / close_spread), F.col("band"))
    wide = F.abs(c - ma60) / ma60 * 100 < centre
    late = F.when((F.col("ma20") > ma60) & (c < F.col("ma20")), "uptrend_breakdown").when((F.col("ma20") < ma60) & (c > F.col("ma20")), "downtrend_breakout").otherwise("sideways")
    return d.withColumn("state", F.when((state == "trend_center") & ~wide, late).otherwise(state))


@query(f"{STATES} SELECT symbol, trade_date, state FROM st")
def d12_trend_states(spark, sf_dir):
    return states(spark, sf_dir).select("symbol", "trade_date", "state")


_STATE_SQL = "CASE state WHEN 'uptrend' THEN 80.0 WHEN 'uptrend_breakdown' THEN 55.0 WHEN 'downtrend_breakout' THEN 65.0 WHEN 'trend_center' THEN 48.0 WHEN 'downtrend' THEN 20.0 ELSE 50.0 END"
MARKET_SCORE = f"{STATES}, ms AS (SELECT trade_date, round(sum(w * greatest(0.0, least(100.0, b + greatest(-10.0, least(10.0, ret20 * 0.5))))) / sum(w), 1) AS score FROM (SELECT *, {_STATE_SQL} AS b, CASE symbol WHEN 'Brand#1' THEN 0.2 WHEN 'Brand#2' THEN 0.3 WHEN 'Brand#3' THEN 0.15 ELSE 0.1 END AS w FROM st) GROUP BY trade_date)"


def market_score(d: DataFrame) -> DataFrame:
    """(trade_date, score) from several series' states and 20-row returns: weighted mean of state scores moved by momentum."""
    scores = F.create_map(*(F.lit(x) for kv in STATE_SCORES.items() for x in kv))
    weights = F.create_map(*(F.lit(x) for kv in {"Brand#1": 0.2, "Brand#2": 0.3, "Brand#3": 0.15}.items() for x in kv))
    w = F.coalesce(F.try_element_at(weights, F.col("symbol")), F.lit(0.1))
    s = clip(F.try_element_at(scores, F.col("state")) + clip(F.col("ret20") * 0.5, -10.0, 10.0), 0.0, 100.0)
    return d.groupBy("trade_date").agg(F.round(F.sum(w * s) / F.sum(w), 1).alias("score"))


def phase(score: Column) -> Column:
    return F.when(score >= 65, "offensive").when(score <= 35, "defensive").otherwise("balanced")


@query(f"{MARKET_SCORE} SELECT trade_date, {{score AS score}}, CASE WHEN score >= 65 THEN 'offensive' WHEN score <= 35 THEN 'defensive' ELSE 'balanced' END AS phase FROM ms")
def sr14_market_score(spark, sf_dir):
    return market_score(states(spark, sf_dir)).withColumn("phase", phase(F.col("score")))


def market_part(m: Column) -> Column:
    return F.when(m >= 65, F.least(F.lit(5.0), (m - 65) * 0.15)).when(m <= 35, -F.least(F.lit(5.0), (35 - m) * 0.15)).otherwise(0.0)


def market_adjustment(m: Column, rank: Column, etf: Column, score: Column) -> Column:
    """Market's level, the sector's rank and the balance of fund trends; halved for extreme scores, never taken off a score of 70 or more."""
    adj = market_part(m) + F.when(rank <= 5, 3.0).when(rank <= 10, 1.5).when(rank > 20, -1.5).otherwise(0.0) + 3 * etf
    adj = F.when((score > 85) | (score < 15), adj * 0.5).otherwise(adj)
    return F.round(clip(F.when((adj < 0) & (score >= 70), 0.0).otherwise(adj), -8.0, 8.0) + 1e-9, 2)


@query(f"{MARKET_SCORE}, {SCORED}, r AS (SELECT symbol, trade_date, trend, rank() OVER (PARTITION BY trade_date ORDER BY heat DESC) AS rk FROM scored), e AS (SELECT trade_date, (count(CASE WHEN state IN ('uptrend', 'downtrend_breakout') THEN 1 END) - count(CASE WHEN state IN ('downtrend', 'uptrend_breakdown') THEN 1 END)) / count(*) AS etf FROM st GROUP BY trade_date), a AS (SELECT r.*, CASE WHEN score >= 65 THEN least(5.0, (score - 65) * 0.15) WHEN score <= 35 THEN -least(5.0, (35 - score) * 0.15) ELSE 0 END + CASE WHEN rk <= 5 THEN 3.0 WHEN rk <= 10 THEN 1.5 WHEN rk > 20 THEN -1.5 ELSE 0.0 END + 3 * etf AS adj FROM r JOIN ms USING (trade_date) JOIN e USING (trade_date)), h AS (SELECT *, CASE WHEN trend > 85 OR trend < 15 THEN adj * 0.5 ELSE adj END AS adj2 FROM a) SELECT symbol, trade_date, {{round(greatest(-8.0, least(8.0, CASE WHEN adj2 < 0 AND trend >= 70 THEN 0.0 ELSE adj2 END)) + 1e-9, 2) AS adj}} FROM h", "panel")
def sr15_market_adjustment(spark, sf_dir):
    st = states(spark, sf_dir)
    up, down = F.count_if(F.col("state").isin("uptrend", "downtrend_breakout")), F.count_if(F.col("state").isin("downtrend", "uptrend_breakdown"))
    etf = st.groupBy("trade_date").agg(((up - down) / F.count(F.lit(1))).alias("etf"))
    d = scored(spark, sf_dir).withColumn("rk", F.rank().over(Window.partitionBy("trade_date").orderBy(F.desc("heat"))))
    d = d.join(market_score(st), "trade_date").join(etf, "trade_date")
    return d.select("symbol", "trade_date", market_adjustment(F.col("score"), F.col("rk"), F.col("etf"), F.col("trend")).alias("adj"))


#: Largest share of a stock by pool.
POOLS = {
    "pool1_v7c_main": 0.025, "pool2_triple_consensus": 0.05, "pool3_oversold_rebound": 0.015, "pool4_bottom_breakout": 0.025, "pool5_policy_wave": 0.015, "pool6_strong_pullback": 0.02,
    "pool7_pyramid_strong": 0.04, "pool8_pullback_long": 0.02, "pool9_pulse_short": 0.01,
}


def assign_pool(multi_window: bool = False) -> Column:
    """The first rule that holds; with `multi_window` also the three pools over 5, 10 and 20 rows, which are off by default."""
    c = F.col
    zombie = F.coalesce(c("is_zombie"), F.lit(False))
    out = F.when(c("recommended") & (c("heat") >= 70), "pool2_triple_consensus").when(c("recommended"), "pool1_v7c_main")
    out = out.when((c("zombie_days") > 0.5) & (c("slope60") > 0.003) & (c("buy") > 60) & ~zombie, "pool4_bottom_breakout").when((c("heat") >= 70) & (c("buy") > 60), "pool5_policy_wave")
    if multi_window:
        out = out.when((F.least("buy_r5", "buy_r10", "buy_r20") >= 75) & ~zombie, "pool7_pyramid_strong").when((c("buy_r20") - c("buy_r5") >= 40) & (c("buy_r20") >= 85) & ~zombie, "pool8_pullback_long")
        out = out.when((c("buy_r5") - c("buy_r10") >= 15) & (c("buy_r5") - c("buy_r20") >= 20) & (c("buy_r5") >= 60) & ~zombie, "pool9_pulse_short")
    out = out.when((c("buy") >= 85) & (c("buy") < 95) & ~c("quadrant").isin("mixed", "short") & ~zombie, "pool6_strong_pullback")
    return out.when((c("r10_pred") > 2.0) & (c("buy") >= 50) & (c("buy") < 75) & (c("sell") < 50) & ~zombie, "pool3_oversold_rebound")


def position_size(regime: float = 1.0) -> Column:
    """A pool's largest share scaled by confidence, between half a percent and one and a half times the share; 0 outside pools."""
    base = F.try_element_at(F.create_map(*(F.lit(x) for kv in POOLS.items() for x in kv)), F.col("pool"))
    confidence = clip(F.col("r20_pred") / 15.0, 0.0, 1.0) * (1.0 - F.col("sell_prob"))
    return F.when(base.isNull(), 0.0).otherwise(F.greatest(F.lit(0.005), F.least(base * 1.5, base * (0.5 + confidence) * regime)))


_POOLED = f"{SCORED}, q AS (SELECT *, trend AS buy, 100 - place_s AS sell, 1 - place_s / 100 AS sell_prob, trend >= 80 AND place_s >= 80 AS recommended, zombie_days > 0.6 AND abs(slope60) < 0.002 AS is_zombie, CASE WHEN trend >= 60 AND place_s < 40 THEN 'mixed' WHEN trend < 40 AND place_s < 40 THEN 'short' ELSE 'other' END AS quadrant FROM scored), p AS (SELECT *, CASE WHEN recommended AND heat >= 70 THEN 'pool2_triple_consensus' WHEN recommended THEN 'pool1_v7c_main' WHEN zombie_days > 0.5 AND slope60 > 0.003 AND buy > 60 AND NOT is_zombie THEN 'pool4_bottom_breakout' WHEN heat >= 70 AND buy > 60 THEN 'pool5_policy_wave' WHEN buy >= 85 AND buy < 95 AND quadrant NOT IN ('mixed', 'short') AND NOT is_zombie THEN 'pool6_strong_pullback' WHEN r10_pred > 2 AND buy >= 50 AND buy < 75 AND sell < 50 AND NOT is_zombie THEN 'pool3_oversold_rebound' END AS pool FROM q)"


def pooled(spark, sf_dir) -> DataFrame:
    c = F.col
    quadrant = F.when((c("trend") >= 60) & (c("place_s") < 40), "mixed").when((c("trend") < 40) & (c("place_s") < 40), "short").otherwise("other")
    d = scored(spark, sf_dir).withColumns({"buy": c("trend"), "sell": 100 - c("place_s"), "sell_prob": 1 - c("place_s") / 100, "recommended": (c("trend") >= 80) & (c("place_s") >= 80), "is_zombie": (c("zombie_days") > 0.6) & (F.abs("slope60") < 0.002), "quadrant": quadrant})
    return d.withColumn("pool", assign_pool())


@query(f"{_POOLED} SELECT symbol, trade_date, pool FROM p", "panel")
def sr17_pools(spark, sf_dir):
    return pooled(spark, sf_dir).select("symbol", "trade_date", "pool")


@query(f"{_POOLED}, b AS (SELECT *, CASE pool {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in POOLS.items())} END AS base FROM p) SELECT symbol, trade_date, pool, {{CASE WHEN pool IS NULL THEN 0.0 ELSE greatest(0.005, least(base * 1.5, base * (0.5 + greatest(0.0, least(1.0, r20_pred / 15)) * (1 - sell_prob)) * 0.8)) END AS size}} FROM b", "panel")
def sr18_sizes(spark, sf_dir):
    return pooled(spark, sf_dir).select("symbol", "trade_date", "pool", position_size(0.8).alias("size"))


@query(f"{SCORED}, s AS (SELECT *, avg(close) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma, CASE WHEN trend > 60 THEN 'up' WHEN trend < 40 THEN 'down' ELSE 'flat' END AS way FROM scored), h AS (SELECT *, greatest(-1.0, least(1.0, CASE way WHEN 'up' THEN 0.4 WHEN 'down' THEN -0.4 ELSE 0.0 END + CASE WHEN place_s < 30 THEN 0.3 WHEN place_s > 75 THEN -0.3 WHEN place_s > 50 AND place_s < 65 THEN 0.2 ELSE 0.0 END + CASE WHEN round(close - ma, 9) > 0 THEN 0.2 ELSE -0.2 END + CASE WHEN 100 * slope60 > 1 THEN 0.2 WHEN 100 * slope60 < -1 THEN -0.2 ELSE 0.0 END + CASE WHEN surge > 1.5 AND way = 'up' THEN 0.2 WHEN surge > 1.5 AND way = 'down' THEN -0.2 ELSE 0.0 END)) AS hs FROM s) SELECT symbol, trade_date, {{hs AS hourly}}, CASE WHEN value_s >= 65 AND round(hs, 6) >= 0.4 THEN 'strong_buy' WHEN value_s < 35 AND round(hs, 6) <= -0.3 THEN 'strong_avoid' WHEN value_s >= 65 AND round(hs, 6) <= -0.3 THEN 'wait_pullback' WHEN value_s < 35 AND round(hs, 6) >= 0.4 THEN 'short_pulse' ELSE 'neutral' END AS consensus FROM h", "panel")
def sr22_hourly_consensus(spark, sf_dir):
    c = F.col
    d = scored(spark, sf_dir).withColumns({"ma": F.avg("close").over(P.by_time().rowsBetween(-19, 0)), "way": F.when(c("trend") > 60, 1).when(c("trend") < 40, -1).otherwise(0)})
    rsi = F.when(c("place_s") < 30, 0.3).when(c("place_s") > 75, -0.3).when((c("place_s") > 50) & (c("place_s") < 65), 0.2).otherwise(0.0)
    slope = F.when(100 * c("slope60") > 1, 0.2).when(100 * c("slope60") < -1, -0.2).otherwise(0.0)
    hourly = clip(0.4 * c("way") + rsi + F.when(F.round(c("close") - c("ma"), 9) > 0, 0.2).otherwise(-0.2) + slope + F.when(c("surge") > 1.5, 0.2 * c("way")).otherwise(0.0), -1.0, 1.0)
    h, daily = F.round("hourly", 6), c("value_s")
    both = F.when((daily >= 65) & (h >= 0.4), "strong_buy").when((daily < 35) & (h <= -0.3), "strong_avoid").when((daily >= 65) & (h <= -0.3), "wait_pullback").when((daily < 35) & (h >= 0.4), "short_pulse").otherwise("neutral")
    return d.withColumn("hourly", hourly).select("symbol", "trade_date", "hourly", both.alias("consensus"))


def exposure(gain: Column, dd: Column, cap: Column, held: Column) -> Column:
    """Percent by predicted gain; none of the largest not held, half of large not held, less at a poor gain for its risk, none under a gain of 8."""
    step = F.when(gain >= 17, 80.0).when(gain >= 15, 60.0).when(gain >= 13, 40.0).when(gain >= 11, 20.0).when(gain >= 9, 10.0).otherwise(5.0)
    step = F.when((cap == 4) & ~held, 0.0).otherwise(step) * F.when((cap >= 3) & ~held, 0.5).otherwise(1.0)
    step = step * F.when(gain / F.greatest(F.abs(dd), F.lit(0.5)) < 1.5, 0.7).otherwise(1.0)
    return F.round(F.when(gain >= 8, step).otherwise(0.0), 1)


_EXPO = f"holdings AS {_HELD}, {SCORED}, e AS (SELECT *, place_s / 5 AS gain, -volume / 10 AS dd, symbol IN (SELECT symbol FROM holdings WHERE k <= 2) AS held FROM scored), x AS (SELECT *, round(CASE WHEN gain >= 8 THEN (CASE WHEN cap = 4 AND NOT held THEN 0.0 WHEN gain >= 17 THEN 80.0 WHEN gain >= 15 THEN 60.0 WHEN gain >= 13 THEN 40.0 WHEN gain >= 11 THEN 20.0 WHEN gain >= 9 THEN 10.0 ELSE 5.0 END) * (CASE WHEN cap >= 3 AND NOT held THEN 0.5 ELSE 1.0 END) * (CASE WHEN gain / greatest(abs(dd), 0.5) < 1.5 THEN 0.7 ELSE 1.0 END) ELSE 0.0 END, 1) AS pos FROM e)"


@query(f"{_EXPO} SELECT CASE WHEN pos <= 5 THEN '0-5' WHEN pos <= 15 THEN '5-15' WHEN pos <= 30 THEN '15-30' WHEN pos <= 50 THEN '30-50' ELSE '50-100' END AS bucket, count(max_gain_20) AS n, {{avg(gain) AS predicted}}, {{avg(max_gain_20) AS gained}}, {{avg(max_dd_20) AS drawn}}, {{avg(CASE WHEN max_gain_20 >= 4 THEN 100.0 WHEN max_gain_20 IS NOT NULL THEN 0.0 END) AS over_4}} FROM x GROUP BY 1", "panel")
def sr25_exposure_ladder(spark, sf_dir):
    held = t(spark, sf_dir, "holdings").where("k <= 2").select("symbol").distinct().withColumn("is_held", F.lit(True))
    d = scored(spark, sf_dir).join(held, "symbol", "left").withColumns({"gain": F.col("place_s") / 5, "pos": exposure(F.col("place_s") / 5, -F.col("volume") / 10, F.col("cap"), F.col("is_held").isNotNull())})
    bucket = F.when(F.col("pos") <= 5, "0-5").when(F.col("pos") <= 15, "5-15").when(F.col("pos") <= 30, "15-30").when(F.col("pos") <= 50, "30-50").otherwise("50-100")
    over = F.avg(F.when(F.col("max_gain_20") >= 4, 100.0).when(F.col("max_gain_20").isNotNull(), 0.0))
    return d.groupBy(bucket.alias("bucket")).agg(F.count("max_gain_20").alias("n"), F.avg("gain").alias("predicted"), F.avg("max_gain_20").alias("gained"), F.avg("max_dd_20").alias("drawn"), over.alias("over_4"))


#: Exposure caps by phase.
CAPS = {"offensive": 0.9, "balanced": 0.6, "defensive": 0.3}


@query(f"{MARKET_SCORE}, p AS (SELECT trade_date, score, CASE WHEN score >= 65 THEN 'offensive' WHEN score <= 35 THEN 'defensive' ELSE 'balanced' END AS phase FROM ms) SELECT trade_date, phase, {{CASE WHEN score >= 75 THEN least(0.95, cap + 0.1) WHEN score <= 25 THEN greatest(0.15, cap - 0.1) ELSE cap END AS position_cap}} FROM (SELECT *, CASE phase WHEN 'offensive' THEN 0.9 WHEN 'balanced' THEN 0.6 ELSE 0.3 END AS cap FROM p)")
def sr26_strategy(spark, sf_dir):
    d = market_score(states(spark, sf_dir)).withColumn("phase", phase(F.col("score")))
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in CAPS.items() for x in kv)), F.col("phase"))
    return d.select("trade_date", "phase", F.when(F.col("score") >= 75, F.least(F.lit(0.95), cap + 0.1)).when(F.col("score") <= 25, F.greatest(F.lit(0.15), cap - 0.1)).otherwise(cap).alias("position_cap"))


REGIMES = "(CASE WHEN ret_20 IS NULL THEN 'mixed' WHEN ret_5 >= {a} AND surge >= 1.3 OR ret_5 >= {b} AND surge >= 1.5 THEN 'bull_policy' WHEN ret_20 >= {c} AND (place > 0.65 OR slope60 > 0.005) OR ret_60 >= {d} THEN 'bull_fast' WHEN abs(ret_20) < {e} AND trend > 55 THEN 'bull_slow_diverge' WHEN ret_60 <= -{f} OR ret_20 <= -{g} AND slope60 < 0 THEN 'bear' WHEN abs(ret_20) < {h} THEN 'sideways' ELSE 'mixed' END)"


def regime(scale: float = 1.0) -> Column:
    """Six regimes by the first rule that holds; `scale` multiplies the rules' percentages."""
    c = F.col
    k = lambda x: x * scale
    policy = ((c("ret_5") >= k(5)) & (c("surge") >= 1.3)) | ((c("ret_5") >= k(3)) & (c("surge") >= 1.5))
    fast = ((c("ret_20") >= k(10)) & ((c("place") > 0.65) | (c("slope60") > 0.005))) | (c("ret_60") >= k(20))
    bear = (c("ret_60") <= -k(8)) | ((c("ret_20") <= -k(7)) & (c("slope60") < 0))
    out = F.when(c("ret_20").isNull(), "mixed").when(policy, "bull_policy").when(fast, "bull_fast").when((F.abs("ret_20") < k(5)) & (c("trend") > 55), "bull_slow_diverge")
    return out.when(bear, "bear").when(F.abs("ret_20") < k(3), "sideways").otherwise("mixed")


_REGIME = REGIMES.format(a=1.5, b=0.9, c=3, d=6, e=1.5, f=2.4, g=2.1, h=0.9)


@query(f"{SCORED} SELECT symbol, trade_date, {_REGIME} AS regime, CASE WHEN ret_60 IS NULL THEN 'unknown' WHEN ret_60 > 1.5 THEN 'bull' WHEN ret_60 < -1.5 THEN 'bear' ELSE 'sideways' END AS three FROM scored", "panel")
def d13_regimes(spark, sf_dir):
    three = F.when(F.col("ret_60").isNull(), "unknown").when(F.col("ret_60") > 1.5, "bull").when(F.col("ret_60") < -1.5, "bear").otherwise("sideways")
    return scored(spark, sf_dir).select("symbol", "trade_date", regime(0.3).alias("regime"), three.alias("three"))


# Evaluation ------------------------------------------------------------------------------------------------

_RANKS = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2"


def _spearman(by: str, x: str, y: str = "r_20") -> str:
    return f"rk AS (SELECT *, {_RANKS.format(by=by, x=x)} AS rx, {_RANKS.format(by=by, x=y)} AS ry FROM ok)"


_SAFE = "covar_pop(rx, ry) / nullif(round(stddev_pop(rx) * stddev_pop(ry), 12), 0)"
_R9 = rounded("r_20", 9)


@query(f"{FACTS}, ok AS (SELECT trade_date, surge, {_R9} AS r_20 FROM facts WHERE r_20 IS NOT NULL AND surge IS NOT NULL), {_spearman('trade_date', 'surge')}, d AS (SELECT trade_date, {_SAFE} AS ic FROM rk GROUP BY trade_date HAVING count(*) >= 10) SELECT count(ic) AS dates, {{avg(ic) AS mean}}, {{stddev_samp(ic) AS sd}}, {{avg(ic) / nullif(stddev_samp(ic), 0) AS ir}}, {{avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS positive}}, {{quantile_cont(ic, 0.1) AS p10}}, {{quantile_cont(ic, 0.9) AS p90}} FROM d", "panel")
def ev04_daily_rank_ic(spark, sf_dir):
    d = facts(spark, sf_dir).withColumn("r_20", F.expr(_R9))
    ic = P.information_coefficients(d, ["surge"], ["r_20"], ["trade_date"]).where("n >= 10")
    return ic.agg(F.count("rank_ic").alias("dates"), F.avg("rank_ic").alias("mean"), F.stddev_samp("rank_ic").alias("sd"), (F.avg("rank_ic") / F.nullif(F.stddev_samp("rank_ic"), F.lit(0.0))).alias("ir"), F.avg(F.when(F.round("rank_ic", 9) > 0, 1.0).when(F.col("rank_ic").isNotNull(), 0.0)).alias("positive"), F.expr("percentile(rank_ic, 0.1D)").alias("p10"), F.expr("percentile(rank_ic, 0.9D)").alias("p90"))


@query(f"{FACTS}, o AS (SELECT industry, cap, count(r_20) AS n, avg(r_20) AS m FROM facts WHERE trade_date < DATE '1996-01-01' GROUP BY ALL), w AS (SELECT industry, cap, count(r_20) AS n, avg(r_20) AS m FROM facts WHERE trade_date >= DATE '1996-01-01' GROUP BY ALL) SELECT coalesce(o.industry, w.industry) AS industry, coalesce(o.cap, w.cap) AS cap, o.n AS n_old, w.n AS n_new, {{o.m AS mean_old}}, {{w.m AS mean_new}}, CASE WHEN o.m IS NULL OR w.m IS NULL THEN 'missing' WHEN sign(round(o.m, 9)) = sign(round(w.m, 9)) THEN 'kept' ELSE 'flipped' END AS change FROM o FULL JOIN w ON o.industry = w.industry AND o.cap = w.cap", "panel")
def ev07_matrix_comparison(spark, sf_dir):
    """The matrix of an earlier and of a later period side by side."""
    d = facts(spark, sf_dir)
    one = lambda x, s: x.groupBy("industry", "cap").agg(F.count("r_20").alias(f"n_{s}"), F.avg("r_20").alias(f"mean_{s}"))
    both = one(d.where("trade_date < DATE '1996-01-01'"), "old").join(one(d.where("trade_date >= DATE '1996-01-01'"), "new"), ["industry", "cap"], "full")
    a, b = F.col("mean_old"), F.col("mean_new")
    return both.withColumn("change", F.when(a.isNull() | b.isNull(), "missing").when(F.signum(F.round(a, 9)) == F.signum(F.round(b, 9)), "kept").otherwise("flipped"))


@query(f"{SCORED}, ok AS (SELECT cap, {_REGIME} AS regime, surge, {_R9} AS r_20 FROM scored WHERE r_20 IS NOT NULL AND surge IS NOT NULL), {_spearman('cap, regime', 'surge')} SELECT cap, regime, count(*) AS n, {{{_SAFE} AS rank_ic}} FROM rk GROUP BY cap, regime HAVING count(*) >= 50", "panel")
def ev12_bucket_ic(spark, sf_dir):
    d = scored(spark, sf_dir).withColumns({"regime": regime(0.3), "r_20": F.expr(_R9)})
    return P.information_coefficients(d, ["surge"], ["r_20"], ["cap", "regime"]).where("n >= 50").select("cap", "regime", "n", "rank_ic")


@query(f"{SCORED}, l AS (SELECT dim, x, band, y FROM (SELECT 'trend' AS dim, trend AS x, {_R9} AS y FROM scored UNION ALL SELECT 'place', place_s, {_R9} FROM scored UNION ALL SELECT 'volume', volume, {_R9} FROM scored), (SELECT unnest([0, 1, 2, 3, 4]) AS band) WHERE y IS NOT NULL AND least(4, floor(x / 20)) = band), k AS (SELECT *, rank() OVER (PARTITION BY dim ORDER BY x) + (count(*) OVER (PARTITION BY dim, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY dim ORDER BY y) + (count(*) OVER (PARTITION BY dim, y) - 1) / 2 AS ry FROM l), a AS (SELECT dim, {_SAFE} AS ic FROM k GROUP BY dim), b AS (SELECT dim, band, count(*) AS n, avg(y) AS mean FROM l GROUP BY ALL) SELECT dim, CAST(band AS INTEGER) AS band, n, {{mean AS mean}}, {{ic AS rank_ic}}, CASE WHEN ic > 0.03 THEN 'raise' WHEN ic < -0.03 THEN 'lower' ELSE 'keep' END AS advice FROM b JOIN a USING (dim)", "panel")
def ev16_calibration(spark, sf_dir):
    """Each dimension's rank correlation with the outcome, its outcome by bands of 20, and what that says about its weight."""
    d = scored(spark, sf_dir).withColumn("y", F.expr(_R9)).where("y IS NOT NULL")
    long = d.select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("dim"), F.col(c).alias("x")) for n, c in (("trend", "trend"), ("place", "place_s"), ("volume", "volume"))))).alias("s")).select("s.*", "y")
    long = long.withColumn("band", F.least(F.lit(4), F.floor(F.col("x") / 20)).cast("int"))
    ranked = long.withColumns({"rx": P.average_rank("x", ["dim"]), "ry": P.average_rank("y", ["dim"])})
    ic = ranked.groupBy("dim").agg((F.covar_pop("rx", "ry") / F.nullif(F.round(F.stddev_pop("rx") * F.stddev_pop("ry"), 12), F.lit(0.0))).alias("rank_ic"))
    bands = long.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    return bands.join(ic, "dim").withColumn("advice", F.when(F.col("rank_ic") > 0.03, "raise").when(F.col("rank_ic") < -0.03, "lower").otherwise("keep"))


_SIDE = "CASE WHEN trend >= 60 THEN 'buy' WHEN trend <= 40 THEN 'sell' ELSE 'hold' END"


@query(f"{SCORED}, s AS (SELECT *, {_SIDE} AS side FROM scored WHERE r_20 IS NOT NULL) SELECT side, count(*) AS n, {{avg(CASE WHEN side = 'sell' THEN CASE WHEN r_20 < 0 THEN 1.0 ELSE 0.0 END WHEN r_20 > 0 THEN 1.0 ELSE 0.0 END) AS direction}}, {{avg(CASE WHEN max_gain_20 >= 3 THEN 1.0 ELSE 0.0 END) AS target_hit}}, {{avg(CASE WHEN max_dd_20 <= -3 THEN 1.0 ELSE 0.0 END) AS stop_hit}}, {{avg(CASE WHEN max_dd_20 <= -3 THEN -3.0 WHEN max_gain_20 >= 3 THEN 3.0 ELSE r_20 END) AS simulated}} FROM s GROUP BY side", "panel")
def ev17_signal_accuracy(spark, sf_dir):
    d = scored(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("side", F.when(F.col("trend") >= 60, "buy").when(F.col("trend") <= 40, "sell").otherwise("hold"))
    yes = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    right = F.when(F.col("side") == "sell", F.col("r_20") < 0).otherwise(F.col("r_20") > 0)
    target, stop = F.col("max_gain_20") >= 3, F.col("max_dd_20") <= -3
    return d.groupBy("side").agg(F.count(F.lit(1)).alias("n"), yes(right).alias("direction"), yes(target).alias("target_hit"), yes(stop).alias("stop_hit"), F.avg(F.when(stop, -3.0).when(target, 3.0).otherwise(F.col("r_20"))).alias("simulated"))


@query(f"{_POOLED}, a AS (SELECT *, r_20 - avg(r_20) OVER (PARTITION BY trade_date) AS alpha FROM p WHERE r_20 IS NOT NULL), w AS (SELECT symbol, trade_date, r_20 - r20_pred AS gap, CASE WHEN heat < 40 AND r_20 > 4 THEN 'reverse' WHEN NOT recommended AND r_20 > 3 THEN 'missed_rocket' WHEN recommended AND round(alpha, 9) < -1 THEN 'false_positive' END AS wrong FROM a) SELECT symbol, trade_date, wrong, {{gap AS gap}} FROM w WHERE wrong IS NOT NULL", "panel")
def ev18_misjudgements(spark, sf_dir):
    d = pooled(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("alpha", F.col("r_20") - F.avg("r_20").over(Window.partitionBy("trade_date")))
    wrong = F.when((F.col("heat") < 40) & (F.col("r_20") > 4), "reverse").when(~F.col("recommended") & (F.col("r_20") > 3), "missed_rocket").when(F.col("recommended") & (F.round("alpha", 9) < -1), "false_positive")
    return d.select("symbol", "trade_date", wrong.alias("wrong"), (F.col("r_20") - F.col("r20_pred")).alias("gap")).where("wrong IS NOT NULL")


@query(f"{SCORED}, d AS (SELECT *, round(trend - lag(trend) OVER ({W_}), 9) AS delta FROM scored) SELECT CASE WHEN delta >= 5 THEN '+5 and more' WHEN delta >= 1 THEN '+1 to +5' WHEN delta > -1 THEN 'about same' WHEN delta > -5 THEN '-1 to -5' ELSE '-5 and less' END AS change, {STATS} FROM d WHERE delta IS NOT NULL GROUP BY 1", "panel")
def ev19_score_changes(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("delta", F.round(F.col("trend") - F.lag("trend").over(P.by_time()), 9)).where("delta IS NOT NULL")
    x = F.col("delta")
    group = F.when(x >= 5, "+5 and more").when(x >= 1, "+1 to +5").when(x > -1, "about same").when(x > -5, "-1 to -5").otherwise("-5 and less")
    return d.groupBy(group.alias("change")).agg(*P.outcome())


# Labels ----------------------------------------------------------------------------------------------------

HOLD = (5, 10, 20, 30, 40)


@query("n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS i FROM bars), c AS (SELECT symbol, trade_date, close, " + ", ".join(f"list(close) OVER ({W_} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS l{h}" for h in HOLD) + " FROM n) SELECT symbol, trade_date, " + ", ".join(f"{{CASE WHEN len(l{h}) = {h} THEN 100 * (l{h}[{h}] / close - 1) END AS r{h}}}, {{CASE WHEN len(l{h}) = {h} THEN list_min(list_transform(range(1, {h + 1}), lambda k: least(0.0, 100 * (l{h}[k] / greatest(close, list_max(l{h}[1:k])) - 1)))) END AS dd{h}}}" for h in HOLD) + " FROM c")
def l01_returns_and_drawdowns(spark, sf_dir):
    """Return and worst drawdown from the running peak over 5 to 40 rows after each close."""
    w = P.by_time()
    d = t(spark, sf_dir, "bars").withColumn("ahead", F.collect_list("close").over(w.rowsBetween(1, max(HOLD))))

    def drawdown(h: int) -> Column:
        start = F.struct(F.col("close").alias("peak"), F.lit(0.0).alias("dd"))
        step = lambda a, c: F.struct(F.greatest(a["peak"], c).alias("peak"), F.least(a["dd"], 100 * (c / F.greatest(a["peak"], c) - 1)).alias("dd"))
        return F.when(F.size("ahead") >= h, F.aggregate(F.slice("ahead", 1, h), start, step, lambda a: a["dd"]))

    return d.select("symbol", "trade_date", *(x for h in HOLD for x in (F.when(F.size("ahead") >= h, 100 * (F.get("ahead", h - 1) / F.col("close") - 1)).alias(f"r{h}"), drawdown(h).alias(f"dd{h}"))))


_UP = f"a AS (SELECT *, row_number() OVER ({W_}) AS i, round(avg(close) OVER ({W_} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS ma5, vol / avg(vol) OVER ({W_} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vr FROM bars), b AS (SELECT *, lag(ma5) OVER ({W_}) AS ma_p, lag(ma5, 5) OVER ({W_}) AS ma_p5, lead(open) OVER ({W_}) AS entry, min(low) OVER ({W_} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS lo, max(high) OVER ({W_} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS hi, list(ma5) OVER ({W_} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS f FROM a)"


@query(f"{_UP}, c AS (SELECT * FROM b WHERE i > 10 AND len(f) = 20 AND close > ma5 AND ma5 > ma_p AND ma_p / ma_p5 - 1 <= 0.005 AND round(vr, 9) >= 1.1 AND lo / entry - 1 >= -0.03 AND hi / entry - 1 >= 0.02 AND f[20] / f[1] - 1 >= 0.002) SELECT symbol, trade_date, {{100 * (hi / entry - 1) AS max_gain}}, {{100 * (lo / entry - 1) AS min_dd}}, {{100 * (f[20] / f[1] - 1) AS ma5_growth}} FROM c WHERE len(list_filter(range(4, 21), lambda k: f[k] / f[k - 1] - 1 < -0.001 AND f[k - 1] / f[k - 2] - 1 < -0.001 AND f[k - 2] / f[k - 3] - 1 < -0.001)) = 0")
def l04_uptrend_starts(spark, sf_dir):
    """Rows where an uptrend starts: four conditions on the past and, for the label, four on the next 20 rows, among them no three declines of MA5 in a row."""
    w = P.by_time()
    ma5 = F.round(F.avg("close").over(w.rowsBetween(-4, 0)), 9)
    d = t(spark, sf_dir, "bars").withColumns({"i": F.row_number().over(w), "ma5": ma5, "vr": F.col("vol") / F.avg("vol").over(w.rowsBetween(-4, 0))})
    n = w.rowsBetween(1, 20)
    d = d.withColumns({"ma_p": F.lag("ma5").over(w), "ma_p5": F.lag("ma5", 5).over(w), "entry": F.lead("open").over(w), "lo": F.min("low").over(n), "hi": F.max("high").over(n), "f": F.collect_list("ma5").over(n)})
    growth = F.get("f", 19) / F.get("f", 0) - 1
    past = (F.col("i") > 10) & (F.col("close") > F.col("ma5")) & (F.col("ma5") > F.col("ma_p")) & (F.col("ma_p") / F.col("ma_p5") - 1 <= 0.005) & (F.round("vr", 9) >= 1.1)
    future = (F.size("f") == 20) & (F.col("lo") / F.col("entry") - 1 >= -0.03) & (F.col("hi") / F.col("entry") - 1 >= 0.02) & (growth >= 0.002)
    # The longest run of declines of more than a tenth of a percent.
    changes = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda k: F.get("f", k) / F.get("f", k - 1) - 1 < -0.001)
    runs = F.aggregate(changes, F.struct(F.lit(0).alias("now"), F.lit(0).alias("max")), lambda a, x: F.struct(F.when(x, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["max"], F.when(x, a["now"] + 1).otherwise(0)).alias("max")), lambda a: a["max"])
    return d.where(past & future).where(runs < 3).select("symbol", "trade_date", (100 * (F.col("hi") / F.col("entry") - 1)).alias("max_gain"), (100 * (F.col("lo") / F.col("entry") - 1)).alias("min_dd"), (100 * growth).alias("ma5_growth"))


_MARKET = CTES["market"].split(",\nmarket AS ")[1]


@query(f"market AS {_MARKET}, f AS (SELECT trade_date, close, lead(close, 20) OVER (ORDER BY trade_date) AS c20, max(high) OVER (ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS h20 FROM market) SELECT trade_date, {{100 * (c20 / close - 1) AS r_20}}, {{100 * (h20 / close - 1) AS max_gain_20}} FROM f WHERE c20 IS NOT NULL")
def l05_benchmark_labels(spark, sf_dir):
    d = P.forward(t(spark, sf_dir, "market"), (20,), entry="close")
    return d.where("r_20 IS NOT NULL").select("trade_date", "r_20", "max_gain_20")


# Further windows -------------------------------------------------------------------------------------------


@query(f"n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back, arg_max(close, trade_date) OVER (PARTITION BY symbol) AS px FROM bars), l AS (SELECT *, vol * power(0.95, back - 1) AS v, ceil(((high + low + close) / 3 - px * 0.985) / (px * 0.03) * 20) AS bin FROM n WHERE back <= 120), b AS (SELECT symbol, px, bin, sum(v) AS v FROM l WHERE bin BETWEEN 1 AND 20 GROUP BY ALL), k AS (SELECT *, v / sum(v) OVER (PARTITION BY symbol) * 100 AS pct, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, bin) AS r FROM b), g AS (SELECT symbol, any_value(px) AS px, sum(CASE WHEN bin <= 10 THEN pct ELSE 0.0 END) AS profit, sum(CASE WHEN r <= 3 THEN pct ELSE 0.0 END) AS top3, sum(v * px * (0.985 + 0.03 * (bin - 0.5) / 20)) / sum(v) AS cost FROM k GROUP BY symbol) SELECT symbol, {{profit AS profit_ratio}}, {{top3 AS concentration}}, {{cost AS avg_cost}}, {{least(100.0, profit * 0.4 + top3 * 0.3 + profit * 0.3) AS health}}, {{100 * (px / cost - 1) AS against_cost}} FROM g")
def w44_chips(spark, sf_dir):
    """Volume at price of a symbol's last 120 rows: 20 bins around the last close, older rows decayed by 0.95 a row."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    px = F.max_by("close", "trade_date").over(Window.partitionBy("symbol"))
    d = t(spark, sf_dir, "bars").withColumns({"back": back, "px": px}).where("back <= 120")
    d = d.withColumns({"v": F.col("vol") * F.pow(F.lit(0.95), F.col("back") - 1), "bin": F.ceil(((F.col("high") + F.col("low") + F.col("close")) / 3 - F.col("px") * 0.985) / (F.col("px") * 0.03) * 20)})
    b = d.where("bin BETWEEN 1 AND 20").groupBy("symbol", "px", "bin").agg(F.sum("v").alias("v"))
    by = Window.partitionBy("symbol")
    b = b.withColumns({"pct": F.col("v") / F.sum("v").over(by) * 100, "r": F.row_number().over(by.orderBy(F.desc("v"), "bin")), "centre": F.col("px") * (0.985 + 0.03 * (F.col("bin") - 0.5) / 20)})
    g = b.groupBy("symbol").agg(F.max("px").alias("px"), F.sum(F.when(F.col("bin") <= 10, F.col("pct")).otherwise(0.0)).alias("profit_ratio"), F.sum(F.when(F.col("r") <= 3, F.col("pct")).otherwise(0.0)).alias("concentration"), (F.sum(F.col("v") * F.col("centre")) / F.sum("v")).alias("avg_cost"))
    health = F.least(F.lit(100.0), F.col("profit_ratio") * 0.4 + F.col("concentration") * 0.3 + F.col("profit_ratio") * 0.3)
    return g.select("symbol", "profit_ratio", "concentration", "avg_cost", health.alias("health"), (100 * (F.col("px") / F.col("avg_cost") - 1)).alias("against_cost"))


@query(f"market AS {_MARKET}, a AS (SELECT trade_date, close, vol, 100 * (close / lag(close, 5) OVER o - 1) AS r5, 100 * (close / lag(close, 20) OVER o - 1) AS r20, avg(close) OVER (ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma5, avg(close) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20, vol / avg(vol) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vr, close - lag(close) OVER o AS ch FROM market WINDOW o AS (ORDER BY trade_date)), b AS (SELECT *, 100 * (ma5 / lag(ma5, 5) OVER (ORDER BY trade_date) - 1) AS slope, sum(greatest(ch, 0.0)) OVER f AS up, sum(greatest(-ch, 0.0)) OVER f AS dn FROM a WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) SELECT trade_date, {{CASE WHEN r20 IS NULL THEN 50.0 ELSE greatest(0.0, least(100.0, 50 + least(15.0, greatest(-15.0, r5 * 1.5)) + least(8.0, greatest(-8.0, slope * 2)) + least(8.0, greatest(-8.0, 100 * (close / ma20 - 1) * 0.8)) + CASE WHEN round(vr, 9) > 1.2 THEN 5 WHEN round(vr, 9) < 0.8 THEN -5 ELSE 0 END + CASE WHEN round(100 * up / nullif(up + dn, 0), 9) > 70 THEN -5 WHEN round(100 * up / nullif(up + dn, 0), 9) < 30 THEN 5 ELSE 0 END)) END AS score}} FROM b")
def w46_index_features(spark, sf_dir):
    """Returns, slope, distance from the mean, volume and RSI of the market series, and the simple index score made of them."""
    w = P.by_time()
    ret = lambda n: 100 * (F.col("close") / F.lag("close", n).over(w) - 1)
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(-(n - 1), 0))
    d = t(spark, sf_dir, "market").withColumns({"r5": ret(5), "r20": ret(20), "ma5": mean("close", 5), "ma20": mean("close", 20), "vr": F.round(F.col("vol") / mean("vol", 20), 9), "ch": F.col("close") - F.lag("close").over(w)})
    f = w.rowsBetween(-13, 0)
    up, down = F.sum(F.greatest("ch", F.lit(0.0))).over(f), F.sum(F.greatest(-F.col("ch"), F.lit(0.0))).over(f)
    d = d.withColumns({"slope": 100 * (F.col("ma5") / F.lag("ma5", 5).over(w) - 1), "rsi": F.round(100 * up / F.nullif(up + down, F.lit(0.0)), 9)})
    score = 50 + clip(F.col("r5") * 1.5, -15.0, 15.0) + clip(F.col("slope") * 2, -8.0, 8.0) + clip(100 * (F.col("close") / F.col("ma20") - 1) * 0.8, -8.0, 8.0) + F.when(F.col("vr") > 1.2, 5).when(F.col("vr") < 0.8, -5).otherwise(0) + F.when(F.col("rsi") > 70, -5).when(F.col("rsi") < 30, 5).otherwise(0)
    return d.select("trade_date", F.when(F.col("r20").isNull(), 50.0).otherwise(clip(score, 0.0, 100.0)).alias("score"))


@query(f"p AS (SELECT symbol, trade_date, close / lag(close) OVER ({W_}) - 1 AS r FROM bars), n AS (SELECT *, exp(sum(ln(1 + coalesce(r, 0.0))) OVER ({W_})) AS nav FROM p) SELECT symbol, trade_date, {{coalesce(r, 0.0) AS r}}, {{nav AS nav}}, {{max(nav) OVER ({W_}) AS peak}}, {{nav / max(nav) OVER ({W_}) - 1 AS drawdown}} FROM n")
def w50_nav(spark, sf_dir):
    w = P.by_time()
    d = t(spark, sf_dir, "bars").select("symbol", "trade_date", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)).alias("r"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(run))).withColumn("peak", F.max("nav").over(run))
    return d.select("symbol", "trade_date", "r", "nav", "peak", (F.col("nav") / F.col("peak") - 1).alias("drawdown"))


@query("d AS (SELECT trade_date, sum(buy_lg_amount - sell_lg_amount + buy_elg_amount - sell_elg_amount) AS m, sum(buy_sm_amount - sell_sm_amount) AS s FROM flow GROUP BY trade_date), a AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, round(avg(m) OVER w, 6) AS m5, round(avg(s) OVER w, 6) AS s5 FROM d WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT trade_date, {CASE WHEN i < 5 THEN NULL WHEN m5 < 0 AND s5 > 0 THEN -5.0 WHEN m5 > 0 AND s5 < 0 THEN 4.0 WHEN m5 > 0 AND s5 > 0 THEN 2.0 WHEN m5 < 0 AND s5 < 0 THEN -3.0 ELSE 0.0 END AS adj} FROM a", "flow")
def w55_market_flow(spark, sf_dir):
    """The whole market's large and small net flow over five dates, as an adjustment of scores."""
    d = t(spark, sf_dir, "flow").groupBy("trade_date").agg(F.sum(F.expr("buy_lg_amount - sell_lg_amount + buy_elg_amount - sell_elg_amount")).alias("m"), F.sum(F.expr("buy_sm_amount - sell_sm_amount")).alias("s"))
    w = Window.orderBy("trade_date")  # one row per date
    m5, s5 = (F.round(F.avg(c).over(w.rowsBetween(-4, 0)), 6) for c in ("m", "s"))
    adj = F.when(F.row_number().over(w) < 5, None).when((m5 < 0) & (s5 > 0), -5.0).when((m5 > 0) & (s5 < 0), 4.0).when((m5 > 0) & (s5 > 0), 2.0).when((m5 < 0) & (s5 < 0), -3.0).otherwise(0.0)
    return d.select("trade_date", adj.alias("adj"))


@query(f"l AS (SELECT symbol, trade_date, close, lag(close, 20) OVER ({W_}) AS p, list(close) OVER ({W_} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l FROM bars) SELECT symbol, trade_date, {{list_min(list_transform(range(1, len(l) + 1), lambda k: l[k] / list_max(l[1:k]) - 1)) AS max_dd_60}}, {{close / p - 1 AS momentum_20}} FROM l")
def w42_drawdown(spark, sf_dir):
    """The worst fall of the close from its running peak, both within the last 60 rows."""
    w = P.by_time()
    d = t(spark, sf_dir, "bars").select("symbol", "trade_date", F.collect_list("close").over(w.rowsBetween(-59, 0)).alias("l"), (F.col("close") / F.lag("close", 20).over(w) - 1).alias("momentum_20"))
    step = lambda a, c: F.struct(F.greatest(a["peak"], c).alias("peak"), F.least(a["dd"], c / F.greatest(a["peak"], c) - 1).alias("dd"))
    worst = F.aggregate("l", F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd")), step, lambda a: a["dd"])
    return d.select("symbol", "trade_date", worst.alias("max_dd_60"), "momentum_20")


# Portfolios ------------------------------------------------------------------------------------------------

_DATES = "rb AS (SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM bars)) WHERE (i - 1) % 4 = 0)"


@query(f"{_DATES}, s AS (SELECT symbol, trade_date, close FROM bars WHERE symbol IN ('Brand#1', 'Brand#2') AND vol > 120 UNION ALL SELECT 'equal', trade_date, avg(close) FROM bars GROUP BY trade_date), g AS (SELECT symbol, rb.trade_date FROM (SELECT DISTINCT symbol FROM s), rb), f AS (SELECT g.symbol, g.trade_date, (SELECT arg_max(close, s.trade_date) FROM s WHERE s.symbol = g.symbol AND s.trade_date <= g.trade_date) AS close FROM g), k AS (SELECT *, arg_min(close, trade_date) OVER (PARTITION BY symbol) AS base FROM f WHERE close IS NOT NULL) SELECT symbol, trade_date, {{close / base AS nav}} FROM k")
def pb04_benchmark_curves(spark, sf_dir):
    """Benchmarks' closes carried forward onto every fourth date and set to 1 at their first; an equal-weight basket beside them."""
    b = t(spark, sf_dir, "bars")
    series = b.where("symbol IN ('Brand#1', 'Brand#2') AND vol > 120").select("symbol", "trade_date", "close").union(b.groupBy("trade_date").agg(F.avg("close").alias("close")).select(F.lit("equal"), "trade_date", "close"))
    dates = b.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date"))).where("(i - 1) % 4 = 0").select("trade_date")
    names = series.select("symbol").distinct()  # the benchmarks, a few
    grid = dates.join(F.broadcast(names))
    d = P.as_of(grid, series, ["close"]).where("close IS NOT NULL")
    base = F.min_by("close", "trade_date").over(Window.partitionBy("symbol"))
    return d.select("symbol", "trade_date", (F.col("close") / base).alias("nav"))


@query(f"{SCORED}, k AS (SELECT *, {_REGIME} AS regime, row_number() OVER (PARTITION BY trade_date ORDER BY surge DESC NULLS LAST, symbol) AS rk FROM scored WHERE r_20 IS NOT NULL), s AS (SELECT trade_date, avg(r_20) AS s FROM k WHERE rk <= 5 GROUP BY trade_date), b AS (SELECT trade_date, 'equal' AS benchmark, avg(r_20) AS m FROM k GROUP BY trade_date UNION ALL SELECT trade_date, 'large', avg(r_20) FROM k WHERE cap >= 3 GROUP BY trade_date), g AS (SELECT trade_date, arg_max(regime, symbol) AS regime FROM k GROUP BY trade_date) SELECT benchmark, regime, count(*) AS n, {{avg(s - m) AS excess}}, {{avg(s - m) / nullif(stddev_samp(s - m) / sqrt(count(*)), 0) AS t}}, {{avg(CASE WHEN s > m THEN 1.0 ELSE 0.0 END) AS wins}} FROM s JOIN b USING (trade_date) JOIN g USING (trade_date) GROUP BY GROUPING SETS ((benchmark), (benchmark, regime))", "panel")
def pb05_paired_excess(spark, sf_dir):
    """Excess of the five of greatest surge over two benchmarks, in all and by regime."""
    d = scored(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("regime", regime(0.3))
    s = P.top_n(d, ["trade_date"], "surge", 5).groupBy("trade_date").agg(F.avg("r_20").alias("s"))
    marks = F.array(F.lit("equal"), F.when(F.col("cap") >= 3, "large"))
    b = d.select("trade_date", "r_20", F.explode(marks).alias("benchmark")).where("benchmark IS NOT NULL").groupBy("trade_date", "benchmark").agg(F.avg("r_20").alias("m"))
    g = d.groupBy("trade_date").agg(F.max_by("regime", "symbol").alias("regime"))
    x = s.join(b, "trade_date").join(g, "trade_date").withColumn("e", F.col("s") - F.col("m"))
    sets = [[F.col("benchmark")], [F.col("benchmark"), F.col("regime")]]
    return x.groupingSets(sets, "benchmark", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("excess"), (F.avg("e") / F.nullif(F.stddev_samp("e") / F.sqrt(F.count(F.lit(1))), F.lit(0.0))).alias("t"), F.avg(F.when(F.col("e") > 0, 1.0).otherwise(0.0)).alias("wins"))


@query(f"{FACTS}, g AS (SELECT tp, cap, CASE WHEN max_gain_20 >= tp THEN tp ELSE r_20 END AS r, max_gain_20 >= tp AS hit FROM facts, (SELECT unnest([2.0, 3.0, 4.0]) AS tp) WHERE r_20 IS NOT NULL) SELECT tp, cap, count(*) AS n, {{avg(r) AS mean}}, {{avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS hit_rate}}, {{avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate}} FROM g GROUP BY GROUPING SETS ((tp), (tp, cap))", "panel")
def pb06_take_profit_grid(spark, sf_dir):
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("tp", F.explode(F.array(*map(F.lit, (2.0, 3.0, 4.0)))))
    hit = F.col("max_gain_20") >= F.col("tp")
    d = d.withColumns({"hit": hit, "r": F.when(hit, F.col("tp")).otherwise(F.col("r_20"))})
    yes = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return d.groupingSets([[F.col("tp")], [F.col("tp"), F.col("cap")]], "tp", "cap").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), yes(F.col("hit")).alias("hit_rate"), yes(F.col("r") > 0).alias("win_rate"))


@query(f"{SCORED}, d AS (SELECT trade_date, avg(trend) AS m FROM scored GROUP BY trade_date), x AS (SELECT s.trade_date, round(s.trend - d.m, 9) > 0 AS above, round(r_20 - avg(r_20) OVER (PARTITION BY s.trade_date), 9) > 0 AS beat FROM scored s JOIN d USING (trade_date) WHERE r_20 IS NOT NULL) SELECT CAST(date_trunc('year', trade_date) AS DATE) AS year, count(*) AS n, {{avg(CASE WHEN above = beat THEN 1.0 ELSE 0.0 END) AS consistent}} FROM x GROUP BY 1", "panel")
def pb07_rank_consistency(spark, sf_dir):
    """How often a symbol scored above the market also returns more than it."""
    every = Window.partitionBy("trade_date")
    d = scored(spark, sf_dir).withColumn("above", F.round(F.col("trend") - F.avg("trend").over(every), 9) > 0).where("r_20 IS NOT NULL")
    d = d.withColumn("beat", F.round(F.col("r_20") - F.avg("r_20").over(every), 9) > 0)
    return d.groupBy(F.to_date(F.date_trunc("year", "trade_date")).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("above") == F.col("beat"), 1.0).otherwise(0.0)).alias("consistent"))


@query("r AS (SELECT symbol, min(trade_date) AS d0, max(trade_date) AS d1, arg_min(close, trade_date) AS a, arg_max(close, trade_date) AS b, arg_min(close, trade_date) FILTER (WHERE trade_date >= DATE '1997-01-01') AS c FROM bars GROUP BY symbol), s AS (SELECT symbol, CASE WHEN symbol LIKE 'Brand#1%' THEN 'first' WHEN symbol LIKE 'Brand#2%' THEN 'second' ELSE 'other' END AS theme, 100 * (power(b / a, 365.0 / (d1 - d0)) - 1) AS annual, 100 * (b / c - 1) AS recent FROM r) SELECT theme, symbol, {annual AS annual}, {recent AS recent} FROM s WHERE annual > -0.5 OR recent > 0")
def pb08_fund_screen(spark, sf_dir):
    """Series by annualised return since their start and by the return of a later interval, with a theme by name."""
    late = F.when(F.col("trade_date") >= F.lit("1997-01-01").cast("date"), F.col("trade_date"))
    d = t(spark, sf_dir, "bars").groupBy("symbol").agg(F.min("trade_date").alias("d0"), F.max("trade_date").alias("d1"), F.min_by("close", "trade_date").alias("a"), F.max_by("close", "trade_date").alias("b"), F.min_by(F.when(late.isNotNull(), F.col("close")), late).alias("c"))
    theme = F.when(F.col("symbol").startswith("Brand#1"), "first").when(F.col("symbol").startswith("Brand#2"), "second").otherwise("other")
    d = d.select(theme.alias("theme"), "symbol", (100 * (F.pow(F.col("b") / F.col("a"), 365.0 / F.datediff("d1", "d0")) - 1)).alias("annual"), (100 * (F.col("b") / F.col("c") - 1)).alias("recent"))
    return d.where("annual > -0.5 OR recent > 0")


@query(f"signals AS {_SIGNALS}, {SCORED}, j AS (SELECT o_orderkey, CASE WHEN s.score >= 60 THEN 'buy' WHEN s.score < 40 THEN 'sell' ELSE 'hold' END AS decision, r_5 FROM signals s JOIN scored USING (symbol, trade_date) WHERE r_5 IS NOT NULL), v AS (SELECT *, CASE WHEN decision = 'buy' AND r_5 > 0 OR decision = 'sell' AND r_5 < 0 THEN 'correct' WHEN decision = 'hold' THEN 'neutral' ELSE 'wrong' END AS verdict FROM j) SELECT decision, count(*) AS total, count(CASE WHEN verdict = 'correct' THEN 1 END) AS correct, count(CASE WHEN verdict = 'wrong' THEN 1 END) AS wrong, count(CASE WHEN verdict = 'neutral' THEN 1 END) AS neutral, {{count(CASE WHEN verdict = 'correct' THEN 1 END) / nullif(count(CASE WHEN verdict <> 'neutral' THEN 1 END), 0) AS accuracy}} FROM v GROUP BY decision", "panel")
def tx05_review(spark, sf_dir):
    """Remembered decisions judged by the return after five rows."""
    s = t(spark, sf_dir, "signals").withColumn("decision", F.when(F.col("score") >= 60, "buy").when(F.col("score") < 40, "sell").otherwise("hold"))
    d = s.join(facts(spark, sf_dir).select("symbol", "trade_date", "r_5").where("r_5 IS NOT NULL"), ["symbol", "trade_date"])
    right = ((F.col("decision") == "buy") & (F.col("r_5") > 0)) | ((F.col("decision") == "sell") & (F.col("r_5") < 0))
    d = d.withColumn("verdict", F.when(right, "correct").when(F.col("decision") == "hold", "neutral").otherwise("wrong"))
    n = lambda v: F.count_if(F.col("verdict") == v)
    return d.groupBy("decision").agg(F.count(F.lit(1)).alias("total"), n("correct").alias("correct"), n("wrong").alias("wrong"), n("neutral").alias("neutral"), (n("correct") / F.nullif(n("correct") + n("wrong"), F.lit(0))).alias("accuracy"))
