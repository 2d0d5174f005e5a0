"""Support and resistance: candidate levels from five sources, clustered along the price, and where the price stands between them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panels import by_time
from .shapes import framed, last, total

#: Moving averages that count as levels, rows of the volume profile and of gaps, bins of the profile.
MEANS, PROFILE, BINS = (20, 60, 120, 250), 60, 20
#: How far from the price, as a share of it, a mean, a dense bin and a round number still count.
NEAR = {"mean": 0.05, "volume": 0.08, "round": 0.06}


def cents(x: Column) -> Column:
    return F.round(x + 3e-9, 2)


def candidates(bars: DataFrame, rows: int = 120) -> DataFrame:
    """(symbol, trade_date, now, side, label, price): one row for each candidate level of each bar that has 30 rows.

    Swings: highs and lows of the last `rows` rows that none in a fifteenth of them (five at least) on both sides exceeds. Means of 20 to 250 rows. The three
    densest of 20 price bins by the volume of the last 60 rows. Unfilled sides of gaps. Round numbers. Prices in cents, each once for a label and side.
    """
    w = by_time()
    means = F.array(*(F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) == n, F.avg("close").over(w.rowsBetween(1 - n, 0))) for n in MEANS))
    d = framed(bars, rows).join(bars.select("symbol", "trade_date", means.alias("means")), ["symbol", "trade_date"]).where("k >= 30")
    d = d.withColumns({"now": last(F.col("c")), "w": F.greatest(F.lit(5), F.floor(F.col("k") / 15).cast("int"))})
    h, l, k, now, side = F.col("h"), F.col("l"), F.col("k"), F.col("now"), F.col("w")
    around = lambda a, i: F.slice(a, i - side + 1, F.least(side * 2 + 1, k - i + side))
    inner = F.sequence(side, k - 2)
    level = lambda side_, label, price: F.struct(side_.alias("side"), F.lit(label).alias("label"), cents(price).alias("price"))
    by_side = lambda label, price: level(F.when(price < now, "support").when(price > now, "resistance"), label, price)
    tops = F.transform(F.filter(inner, lambda i: (F.get(h, i) == F.array_max(around(h, i))) & (F.get(h, i) > F.get(h, i - 1))), lambda i: level(F.when(F.get(h, i) > now, "resistance").otherwise("support"), "swing_high", F.get(h, i)))
    lows = F.transform(F.filter(inner, lambda i: (F.get(l, i) == F.array_min(around(l, i))) & (F.get(l, i) < F.get(l, i - 1))), lambda i: level(F.when(F.get(l, i) < now, "support").otherwise("resistance"), "swing_low", F.get(l, i)))
    close_to = lambda price, kind: F.abs(price - now) / now < NEAR[kind]
    averages = F.transform(F.filter("means", lambda m: close_to(m, "mean")), lambda m: by_side("mean", m))
    recent = lambda c: F.slice(F.col(c), F.greatest(F.lit(1), k - PROFILE + 1), PROFILE)
    d = d.withColumns({"h60": recent("h"), "l60": recent("l"), "v60": recent("v")})
    d = d.withColumns({"lo": F.array_min("l60"), "hi": F.array_max("h60"), "rows60": F.arrays_zip("h60", "l60", "v60")})
    edge = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * j / BINS
    volume = lambda j: total(F.transform(F.filter("rows60", lambda r: (r["l60"] <= edge(j + 1)) & (r["h60"] >= edge(j))), lambda r: r["v60"]))
    profile = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.struct(F.round(volume(j), 3).alias("v"), j.alias("j")))
    d = d.withColumn("dense", F.when((k >= PROFILE) & (F.col("hi") > F.col("lo")), F.slice(F.sort_array(profile, asc=False), 1, 3)).otherwise(F.slice(profile, 1, 0)))
    middle = lambda b: (edge(b["j"]) + edge(b["j"] + 1)) / 2
    dense = F.transform(F.filter("dense", lambda b: close_to(middle(b), "volume")), lambda b: by_side("volume", middle(b)))
    later = F.when(k >= 2, F.sequence(F.greatest(F.lit(1), k - PROFILE), k - 1)).otherwise(F.array().cast("array<int>"))
    ups = F.transform(F.filter(later, lambda i: (F.get(l, i) > F.get(h, i - 1)) & (F.get(h, i - 1) < now)), lambda i: level(F.lit("support"), "gap", F.get(h, i - 1)))
    downs = F.transform(F.filter(later, lambda i: (F.get(h, i) < F.get(l, i - 1)) & (F.get(l, i - 1) > now)), lambda i: level(F.lit("resistance"), "gap", F.get(l, i - 1)))
    unit = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(now + 1e-8)) - 1))
    rounds = F.transform(F.array(*(F.lit(m) for m in (-1, 0, 1))), lambda m: (F.round(now / unit) + m) * unit)
    rounds = F.transform(F.filter(rounds, lambda x: (x > 0) & close_to(x, "round")), lambda x: by_side("round", x))
    every = F.array_distinct(F.concat(tops, lows, averages, dense, ups, downs, rounds))
    d = d.select("symbol", "trade_date", "now", F.explode_outer(every).alias("x")).select("symbol", "trade_date", "now", "x.*")
    return d.where("side IS NOT NULL")


def clustered(found: DataFrame, apart: float = 0.002) -> DataFrame:
    """(symbol, trade_date, now, side, rank, price, low, high, strength, labels): candidates of a side less than `apart` of the price from the next one are one level.

    Its price is their mean, its strength their number; rank 1 is the level nearest to the price.
    """
    keys = ["symbol", "trade_date", "side"]
    w = Window.partitionBy(*keys).orderBy("price", "label")
    d = found.withColumn("new", F.when(F.round(F.col("price") - F.lag("price").over(w), 6) <= F.round(F.col("now") * apart, 6), 0).otherwise(1))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy(*keys, "now", "island").agg(F.round(F.avg("price") + 3e-9, 6).alias("price"), F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("strength"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    near = Window.partitionBy(*keys).orderBy(F.round(F.abs(F.col("price") - F.col("now")), 6), "price")
    return d.select("symbol", "trade_date", "now", "side", F.row_number().over(near).alias("rank"), "price", "low", "high", "strength", "labels")


def position(levels: DataFrame) -> DataFrame:
    """(symbol, trade_date, support, resistance, support_strength, resistance_strength, position, score) from the nearest level of each side."""
    at = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col("rank") == 1), F.col(c)))
    d = levels.groupBy("symbol", "trade_date").agg(F.max("now").alias("now"), *(at(s, c).alias(n) for s in ("support", "resistance") for c, n in (("price", s), ("strength", f"{s}_strength"))))
    s, r = F.col("support"), F.col("resistance")
    share = F.round((F.col("now") - s) / F.when(r > s, r - s).when(r <= s, 1.0), 9)
    d = d.withColumn("position", F.when(share < 0.25, "near_support").when(share > 0.75, "near_resistance").otherwise("middle"))
    score = F.when(s.isNotNull() & r.isNotNull(), F.when(F.col("position") == "near_support", 15).when(F.col("position") == "near_resistance", -15).otherwise(0)).when(s.isNotNull(), 10).otherwise(-10)
    return d.withColumn("score", score).drop("now")
