"""The sparse layered score: each factor speaks only where its value's fifth has an outcome of its own in the row's segments.

A validity table has, for each (factor, dim, seg), the four thresholds of its fifths, the fifths' win rates, mean returns and sizes, the middle
fifth's win rate and whether the segment is active at all. A row's factors are looked up in the tables of three
dims, which are small and joined to the rows as three equi-joins, so that all of a factor's evidence stands in its row and one aggregate by row gives the score.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panels import ranked_in_ranges

#: Factors of momentum and of reversal, and those that the flow of money can confirm or veto.
MOMENTUM = (
    "macd_hist", "macd", "rsi_24", "rsi_14", "rsi_6", "mfi_14", "ppo", "trix", "kama_dist", "ma5_ma20", "kdj_k", "kdj_d", "stochrsi_k",
    "lr_slope_20", "lr_slope_60", "lr_angle_20", "cmo_14", "aroon_up", "aroon_osc", "roc_10", "roc_20",
)
REVERSAL = ("ma_ratio_60", "ma_ratio_120", "channel_pos_60", "ma20_ma60", "sump_20", "sumn_20", "rank_20", "rsv_20", "wr_14", "qtlu_20", "qtld_20")
GATED = ("ma_ratio_60", "ma_ratio_120", "channel_pos_60", "ma20_ma60", "trix", "sump_20", "ma_ratio_20", "macd_hist", "rsi_24", "mfi_14", "ppo", "kama_dist")
#: What a market's trend multiplies momentum and reversal by.
TREND = {"slow_bull": (1.1, 0.9), "fast_bull": (1.2, 0.8), "bear": (0.8, 1.2)}
#: Dims in the order in which their fifths are named.
DIMS = ("mv", "industry", "pe")
SHARES = (0.2, 0.4, 0.6, 0.8)


def group_percentiles(d: DataFrame, x: str, by: list[str], shares: Sequence[float]) -> DataFrame:
    """(by, n, thresholds): linearly interpolated percentiles of x in each group, from places within ranges, so that no task holds a group."""
    ranked = ranked_in_ranges(d.select(*by, x), x, "k", by=tuple(by), ties=())
    ranked = ranked.join(ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    out = []
    for p in shares:
        at = F.round((F.col("n") - 1) * float(p), 9)
        part = F.when(F.col("k") - 1 == F.floor(at), 1 - (at - F.floor(at))).when(F.col("k") - 1 == F.floor(at) + 1, at - F.floor(at))
        out.append(F.round(F.sum(F.when(part > 0, F.col(x) * part)), 12))
    return ranked.groupBy(*by).agg(F.first("n").alias("n"), F.array(*out).alias("thresholds"))


def fifth(value: Column, thresholds: Column) -> Column:
    return F.size(F.filter(thresholds, lambda b: b <= value)) + 1


def validity_table(long: DataFrame, least: int = 20, gain: float = 0.05) -> DataFrame:
    """(factor, dim, seg, thresholds, wins, avgs, ns, q3_win, active) from rows (factor, dim, seg, value, r) with returns r in percent.

    Fifths of fewer than `least` rows have no rate; a segment is active if its best fifth wins `gain` more often than the middle one.
    Rows without value, return or segment are left out.
    """
    keys = ["factor", "dim", "seg"]
    d = long.where("value IS NOT NULL AND r IS NOT NULL AND seg IS NOT NULL")
    cells = d.join(group_percentiles(d, "value", keys, SHARES).drop("n"), keys)
    cells = cells.groupBy(*keys, "thresholds", fifth(F.col("value"), F.col("thresholds")).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win"), F.avg("r").alias("avg"))
    enough = lambda c: F.when(F.col("n") >= least, F.col(c))
    five = lambda x: F.array(*(F.max(F.when(F.col("q") == q, x)) for q in range(1, 6)))
    t = cells.groupBy(*keys, "thresholds").agg(five(enough("win")).alias("wins"), five(enough("avg")).alias("avgs"), five(F.col("n")).alias("ns"))
    t = t.withColumn("q3_win", F.get("wins", F.lit(2)))
    return t.withColumn("active", F.coalesce(F.array_max("wins") - F.col("q3_win") >= gain, F.lit(False)))


def looked_up(d: DataFrame, table: DataFrame, dim: str) -> DataFrame:
    """`d` with struct `__<dim>` of the segment's table, null where the segment has none."""
    own = table.where(F.col("dim") == dim).select(F.col("factor").alias("__f"), F.col("seg").alias("__s"), F.struct("thresholds", "wins", "avgs", "ns", "q3_win", "active").alias(f"__{dim}"))
    return d.join(own, (F.col("name") == F.col("__f")) & (F.col(dim) == F.col("__s")), "left").drop("__f", "__s")


def evidence(value: Column, seg: Column, mode: str, shrink: float | None) -> Column:
    """Struct of fifth, its outcome, the middle one's and whether the segment is active; null without any of them."""
    q = fifth(value, seg["thresholds"])
    outcomes = seg["avgs"] if mode == "avg" else seg["wins"]
    got = F.get(outcomes, q - 1)
    middle = F.get(outcomes, F.lit(2)) if mode == "avg" else seg["q3_win"]
    if shrink:  # towards the middle fifth, the more the fewer rows a fifth has
        n = F.get(seg["ns"], q - 1)
        got = F.when(n > 0, (1 - shrink / (n + shrink)) * got + shrink / (n + shrink) * middle).otherwise(got)
    best = F.array_max(F.filter(outcomes, lambda x: x.isNotNull()))
    active = ((best - middle >= 1.5) & (best >= 0)) if mode == "avg" else F.coalesce(seg["active"], F.lit(False))
    full = seg.isNotNull() & (F.size(seg["thresholds"]) >= 4) & got.isNotNull() & middle.isNotNull()
    return F.when(full, F.struct(q.alias("q"), got.alias("got"), middle.alias("middle"), (got - middle).alias("excess"), active.alias("active")))


def gate(delta: Column, state: Column, gated: Column) -> tuple[Column, Column]:
    """The delta after the flow of money, and the gate's name: inflow confirms a buy and three rows of outflow veto it; a sell is halved unless money leaves."""
    inflow, outflow = state.isin("main_inflow", "main_inflow_3d"), state == "main_outflow_3d"
    some = state.isNotNull() & gated
    name = F.when(some & (delta > 0), F.when(inflow, "mf_inflow_confirm").when(outflow, "mf_outflow_veto").otherwise("mf_neutral")).when(some & (delta < 0), F.when(outflow, "mf_outflow_confirm").otherwise("mf_neutral"))
    return F.when(name == "mf_outflow_veto", 0.0).when(name == "mf_neutral", delta * 0.5).otherwise(delta), name


def layered_score(rows: DataFrame, table: DataFrame, keys: Sequence[str] = ("symbol", "trade_date"), mode: str = "win", shrink: float | None = None, scale: float = 30.0, most: float = 8.0, damped: bool = True) -> DataFrame:
    """One row for each of `keys` of `rows`: (keys, name, value, mv, pe, industry, etf_held, mf_state, trend), one row for each factor.

    Returns layered_score, signal, sum_delta, k_weight, conflict, confidence, n_active, n_silent, active and silent. `active` are structs of name, q, w_eff,
    q3_eff, delta, sign, regime_mul, etf_mul and gate, the weightiest first; `silent` of name and reason. A factor is silent with no table for any of its
    segments, no fifth that differs from the middle one (by 4 points; by 1.5 percent in mode "avg"), dims that disagree, no active segment, or a
    delta under 0.1. Conflict is the mean over pairs of active factors of opposite masses; over 0.25 and 0.45 it damps the sum. Factors without a value, or
    that the table doesn't have, don't count. `shrink` is the number of rows at which a fifth's rate is drawn half to the middle one's.
    """
    keys = list(keys)
    known = table.select(F.col("factor").alias("name")).distinct()
    d = rows.where("value IS NOT NULL").join(known, "name", "left_semi")
    for dim in DIMS:
        d = looked_up(d, table, dim)
    threshold, scale = (1.5, scale / 30) if mode == "avg" else (0.04, scale)
    d = d.withColumn("seen", F.filter(F.array(*(evidence(F.col("value"), F.col(f"__{dim}"), mode, shrink) for dim in DIMS)), lambda e: e.isNotNull()))
    d = d.withColumns({"none": F.coalesce(*(F.col(f"__{dim}") for dim in DIMS)).isNull(), "said": F.filter("seen", lambda e: F.abs(e["excess"]) >= threshold)})
    n = F.size("said")
    mean = lambda f: F.aggregate(F.transform("said", lambda e: e[f]), F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    d = d.withColumns({"excess": mean("excess"), "w_eff": mean("got"), "q3_eff": mean("middle"), "ups": F.size(F.filter("said", lambda e: e["excess"] > 0)), "any": F.exists("said", lambda e: e["active"])})
    side = F.when(F.col("name").isin(*MOMENTUM), 0).when(F.col("name").isin(*REVERSAL), 1)
    regime = F.lit(1.0)
    for trend, factors in TREND.items():
        regime = F.when((F.col("trend") == trend) & side.isNotNull(), F.when(side == 0, factors[0]).otherwise(factors[1])).otherwise(regime)
    # Held by funds: momentum of large caps counts more, reversal of small ones less.
    etf = F.when(F.col("etf_held") & F.col("mv").isin("3", "4") & (side == 0), 1.3).when(F.col("etf_held") & F.col("mv").isin("0", "1") & (side == 1), 0.7).otherwise(1.0)
    d = d.withColumns({"regime_mul": regime, "etf_mul": etf}).withColumn("raw", F.col("excess") * scale * F.col("regime_mul") * F.col("etf_mul"))
    after, name = gate(F.col("raw"), F.col("mf_state"), F.col("name").isin(*GATED))
    d = d.withColumns({"gate": name, "after": F.greatest(F.lit(-most), F.least(F.lit(most), after))})
    reason = F.when(F.col("none"), "no_segment").when(n == 0, "not_extreme").when((F.col("ups") > 0) & (F.col("ups") < n), "dims_disagree").when(~F.col("any"), "no_active_segment").when(F.abs("after") < 0.1, "too_small")
    d = d.withColumn("reason", reason).withColumn("delta", F.when(F.col("reason").isNull(), F.round(F.col("after") + 3e-9, 2)))
    active = F.struct(F.abs("delta").alias("o"), "name", F.get("seen", F.lit(0))["q"].alias("q"), F.round("w_eff", 4).alias("w_eff"), F.round("q3_eff", 4).alias("q3_eff"), "delta", F.when(F.col("ups") > 0, 1).otherwise(-1).alias("sign"), "regime_mul", "etf_mul", "gate")
    up, down = F.greatest(F.col("delta"), F.lit(0.0)), F.greatest(-F.col("delta"), F.lit(0.0))
    g = d.groupBy(*keys).agg(
        F.coalesce(F.round(F.sum("delta"), 9), F.lit(0.0)).alias("sum_delta"), F.count("delta").alias("n_active"), F.count("reason").alias("n_silent"), F.max(F.abs("delta")).alias("top"), F.sum(up).alias("l"), F.sum(down).alias("s"),
        F.collect_list(F.when(F.col("delta").isNotNull(), active)).alias("a"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("name", "reason")))).alias("silent"),
    )
    # No factor is for and against at once, so the pairs' products sum to (sum of long) x (sum of short).
    pairs = F.col("n_active") * (F.col("n_active") - 1) / 2.0
    g = g.withColumn("conflict", F.when((F.col("n_active") < 2) | (F.col("top") <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.round(F.col("l") * F.col("s") / (F.col("top") * F.col("top")) / F.nullif(pairs, F.lit(0.0)), 9))))
    k, active_n = F.col("conflict"), F.col("n_active")
    g = g.withColumns({"k_weight": F.when(k > 0.45, 0.6).when(k > 0.25, 0.85).otherwise(1.0) if damped else F.lit(1.0), "confidence": F.when(active_n == 0, "none").when((active_n < 3) | (k > 0.45), "low").when(k > 0.25, "med").otherwise("high")})
    g = g.withColumn("layered_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.col("sum_delta") * F.col("k_weight"))) + 3e-9, 2))
    score = F.col("layered_score")
    g = g.withColumn("signal", F.when(score >= 65, "enter").when(score >= 50, "hold").when(score >= 35, "reduce").otherwise("exit"))
    order = F.array_sort("a", lambda x, y: F.when(x["o"] != y["o"], F.when(x["o"] > y["o"], -1).otherwise(1)).when(x["name"] < y["name"], -1).otherwise(1))
    return g.select(*keys, "layered_score", "signal", F.round("sum_delta", 2).alias("sum_delta"), "k_weight", F.round("conflict", 4).alias("conflict"), "confidence", "n_active", "n_silent", F.transform(order, lambda x: x.dropFields("o")).alias("active"), "silent")
