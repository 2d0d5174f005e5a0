"""A score of 50 plus the steps of eleven ladders, some of which turn round with the size of the company."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes from which a company is of middle size and large.
MIDDLE, LARGE = 100.0, 1000.0


def ladders(moves: float = 1.0) -> dict[str, list[tuple[Column, float]]]:
    """By factor, conditions and steps, the first that holds. `moves` scales the thresholds of relative moves (their steps are for daily bars).

    Columns: adx, pdi, mdi; winner_rate; divergence; main_rate_ma3 and main_net_ma3 (used without the rate); main_days; holder_pct; mv; ma_ratio_60; mfi; rsi_24; trix; pe; atr_pct.
    """
    c = F.col
    small, large = c("mv") < MIDDLE, c("mv") >= LARGE
    up = c("pdi") > c("mdi")
    known = c("adx").isNotNull() & c("pdi").isNotNull() & c("mdi").isNotNull()
    rate, net = c("main_rate_ma3"), F.when(c("main_rate_ma3").isNull(), c("main_net_ma3"))
    holders = F.when(F.abs("holder_pct") <= 500, c("holder_pct"))
    ratio, risky = c("ma_ratio_60"), (c("pe") >= 100) | (c("pe") < 0)
    return {
        "adx": [(known & (c("adx") >= 30) & up, 10.0), (known & (c("adx") >= 25) & up, 6.0), (known & (c("adx") >= 25), -8.0), (known & (c("adx") < 20), -2.0)],
        "winner_rate": [(c("winner_rate") <= 20, 12.0), (c("winner_rate") <= 35, 6.0), (c("winner_rate") >= 85, -10.0), (c("winner_rate") >= 75, -5.0)],
        "mf_divergence": [(c("divergence") == "distribution", -12.0), (c("divergence") == "smart_accumulating", 8.0), (c("divergence") == "consensus_buy", 3.0), (c("divergence") == "consensus_sell", -5.0)],
        "mf_strength": [(rate >= 3, 10.0), (rate >= 1, 5.0), (rate <= -3, -10.0), (rate <= -1, -5.0), (net >= 5000, 10.0), (net >= 1000, 5.0), (net <= -5000, -10.0), (net <= -1000, -5.0)],
        "mf_consecutive": [(c("main_days") >= 5, 5.0), (c("main_days") >= 3, 3.0)],
        "holders": [(holders <= -5, 8.0), (holders <= -2, 4.0), (holders >= 5, -6.0), (holders >= 2, -3.0)],
        # Small companies come back to their mean, large ones go on.
        "layer_ma_ratio60": [(small & (ratio < -0.04 * moves), 6.0), (small & (ratio > 0.10 * moves), -6.0), (small & (ratio > 0.04 * moves), -3.0), (large & (ratio > 0.04 * moves), 5.0), (large & (ratio < -0.04 * moves), -3.0)],
        "layer_mfi": [((c("mv") >= 300) & (c("mfi") >= 75), 5.0), ((c("mv") >= 300) & (c("mfi") >= 60), 3.0), (small & (c("mfi") >= 80), -3.0)],
        "layer_rsi24": [(large & (c("rsi_24") >= 65), 4.0), (large & (c("rsi_24") >= 55), 2.0), (large & (c("rsi_24") <= 35), -2.0)],
        "layer_trix": [(small & (c("trix") > 0.5), -3.0), (small & (c("trix") < -0.5), 3.0)],
        "layer_pe_atr": [((c("pe") > 0) & (c("pe") < 15) & (c("atr_pct") > 0.04), 2.0), (risky & (c("atr_pct") > 0.05), -4.0)],
    }


def quant_score(rows: DataFrame, keys: tuple[str, ...] = ("symbol", "trade_date"), moves: float = 1.0) -> DataFrame:
    """(keys, score, total, adjustments): 50 plus the ladders' steps, within 0 to 100, and the steps that are not 0 as structs of factor and delta.

    A factor without data adds nothing; changes of holders over 500 % are taken for errors. No factor at all gives 50 and no adjustments.
    """
    steps = []
    for factor, rungs in ladders(moves).items():
        step = F.lit(None).cast("double")
        for cond, delta in reversed(rungs):
            step = F.when(cond, delta).otherwise(step)
        steps.append(F.when(step.isNotNull(), F.struct(F.lit(factor).alias("factor"), step.alias("delta"))))
    d = rows.select(*keys, F.filter(F.array(*steps), lambda s: s.isNotNull()).alias("adjustments"))
    total = F.aggregate("adjustments", F.lit(0.0), lambda a, s: a + s["delta"])
    return d.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + total)).alias("score"), total.alias("total"), "adjustments")
