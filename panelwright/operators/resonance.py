"""Agreement of three time frames, the higher one with a veto: bars of a higher frame count only once they are finished."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panels import as_of, by_time


def finished(bars: DataFrame, unit: str) -> DataFrame:
    """(symbol, trade_date, bulls, body): of each calendar `unit` how many of the last three bars rose and its own body in percent, dated by the first day after it."""
    period = F.date_trunc(unit, "trade_date")
    d = bars.groupBy("symbol", period.alias("start")).agg(F.min_by("open", "trade_date").alias("open"), F.max_by("close", "trade_date").alias("close"))
    w = Window.partitionBy("symbol").orderBy("start")
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    bulls = F.sum(F.when(F.col("close") > F.col("open"), 1).otherwise(0)).over(w.rowsBetween(-2, 0))
    return d.select("symbol", F.add_months("start", months).alias("trade_date"), bulls.cast("int").alias("bulls"), F.round(100 * (F.col("close") / F.col("open") - 1), 9).alias("body"))


def states(bars: DataFrame, middle: str = "month", high: str = "quarter", moves: float = 1.0, crash: float = -5.0) -> DataFrame:
    """(symbol, trade_date, high, middle, base): each frame's state from -2 (strongly down) to 2.

    The high frame is judged by the means of 20, 60 and 120 rows, at most -1 after a bar of under `crash` percent; the middle one by those of 5 and 20 rows and the slope
    over 20, raised by three rising bars and lowered by none; the base one by slope and move over 20 rows. `moves` scales the percents of moves. Means need all their rows.
    """
    w = by_time()
    close = F.col("close")
    back = lambda n: w.rowsBetween(1 - n, 0)
    full = lambda n, x: F.when(F.count("close").over(back(n)) == n, x)
    d = bars.select("symbol", "trade_date", "close", F.row_number().over(w).alias("i"), F.lag("close", 20).over(w).alias("c20"))
    d = d.withColumns({f"ma{n}": full(n, F.avg("close").over(back(n))) for n in (5, 20, 60, 120)} | {"slope": full(20, F.round(100 * F.regr_slope("close", "i").over(back(20)) / F.avg("close").over(back(20)), 9))})
    pct = lambda a, b: F.round(100 * (F.col(a) / F.col(b) - 1), 9)
    d = d.withColumns({"p20": pct("close", "ma20"), "p60": pct("close", "ma60"), "p120": pct("close", "ma120"), "m20": pct("ma20", "ma60"), "m5": pct("ma5", "ma20"), "mom": pct("close", "c20")})
    for unit, name in ((middle, "__mid"), (high, "__high")):
        more = finished(bars, unit).select("symbol", "trade_date", F.col("bulls").alias(f"{name}_bulls"), F.col("body").alias(f"{name}_body"))
        d = as_of(d, more, [f"{name}_bulls", f"{name}_body"]).drop("as_of")
    c = F.col
    above, below, rising, falling = c("p60") > 0, c("p60") < 0, c("m20") > 0, c("m20") < 0
    with_120 = F.when(above & (c("p120") > 0) & rising & (c("p60") > 3 * moves), 2).when(above & rising, 1).when(below & (c("p120") < 0) & falling & (c("p60") < -5 * moves), -2).when(below & falling, -1).otherwise(0)
    only_60 = F.when((c("p60") > 3 * moves) & rising, 1).when(c("p60") < -5 * moves, -1).otherwise(0)
    top = F.when(c("ma120").isNotNull(), with_120).when(c("ma60").isNotNull(), only_60).otherwise(0)
    top = F.when(c("__high_body") < crash * moves, F.least(top, F.lit(-1))).otherwise(top)
    up, down = (c("p20") > 0) & (c("m5") > 0), (c("p20") < 0) & (c("m5") < 0)
    mid = F.when(up & (c("slope") > 0.05) & (c("p20") > 3 * moves), 2).when(up & (c("slope") > 0), 1).when(down & (c("slope") < -0.05), -2).when(down, -1).otherwise(0)
    mid = F.when((c("__mid_bulls") >= 3) & (mid >= 0), F.greatest(mid, F.lit(1))).when((c("__mid_bulls") == 0) & (mid <= 0), F.least(mid, F.lit(-1))).otherwise(mid)
    base = F.when((c("slope") > 0.03) & (c("mom") > 5 * moves), 2).when((c("slope") > 0) & (c("mom") > 0), 1).when((c("slope") < -0.03) & (c("mom") < -5 * moves), -2).when((c("slope") < 0) & (c("mom") < 0), -1).otherwise(0)
    return d.select("symbol", "trade_date", top.alias("high"), mid.alias("middle"), base.alias("base"))


def resonance(high: Column, middle: Column, base: Column) -> Column:
    """10 to 90: all three agreeing count most, then the high frame decides, with a veto where it points down; without one the middle frame."""
    total = high + middle + base
    all_up, all_down = (high >= 1) & (middle >= 1) & (base >= 1), (high <= -1) & (middle <= -1) & (base <= -1)
    by_middle = lambda up, flat, down: F.when(middle >= 1, up).when(middle == 0, flat).otherwise(down)
    veto = F.when(base >= 1, 32).when(middle <= -1, 28).otherwise(38)
    neutral = F.when(middle == 2, 65).when(middle == 1, 58).when(middle == -2, 32).when(middle == -1, 42).when(base >= 1, 53).when(base <= -1, 47).otherwise(50)
    score = F.when(all_up, 75 + (total - 3) * 4).when(all_down, 25 + (total + 3) * 4).when(high == 2, by_middle(70, 60, 50)).when(high == 1, by_middle(65, 55, 45)).when(high == -2, F.when(base >= 1, 22).otherwise(18)).when(high == -1, veto).otherwise(neutral)
    return F.greatest(F.lit(10), F.least(F.lit(90), score))
