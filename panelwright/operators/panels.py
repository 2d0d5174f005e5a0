"""Labels, ranks, joins, aggregations, evaluation, scores and portfolios over panels, as functions of DataFrames.

Keys are (symbol, trade_date) unless a function says otherwise. Nothing here collects rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

SYMBOL, DATE = "symbol", "trade_date"
CAP_BOUNDS = (50.0, 100.0, 300.0, 1000.0)
PE_BOUNDS = (0.0, 15.0, 30.0, 50.0, 100.0)
HORIZONS = (5, 10, 20)


def by_time() -> Window:
    return Window.partitionBy(SYMBOL).orderBy(DATE)


# Labels -------------------------------------------------------------------------------------------------


def forward(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, entry: str = "open") -> DataFrame:
    """r_h, max_gain_h and max_dd_h in percent: entry at the next open (or this close), exit at the close h rows on; null without a full horizon."""
    w = by_time()
    start = F.lead("open", 1).over(w) if entry == "open" else F.col("close")
    d = bars.withColumn("entry", start)
    for h in horizons:
        f = w.rowsBetween(1, h)
        full = F.count("close").over(f) == h
        pct = lambda x: F.when(full, 100 * (x / F.col("entry") - 1))
        d = d.withColumns({f"r_{h}": pct(F.lead("close", h).over(w)), f"max_gain_{h}": pct(F.max("high").over(f)), f"max_dd_{h}": pct(F.min("low").over(f))})
    return d


def is_clean(labelled: DataFrame, gain: float = 2.0, dd: float = -1.0, h: int = 20) -> Column:
    return (F.col(f"max_gain_{h}") >= gain) & (F.col(f"max_dd_{h}") > dd)


def path_class(labelled: DataFrame, h: int = 20) -> Column:
    """strong, mild, fake (rose, then fell back), falling or sideways."""
    gain, dd, r = (F.col(f"{x}_{h}") for x in ("max_gain", "max_dd", "r"))
    return F.when(gain.isNull(), None).when((gain >= 6) & (dd > -3), "strong").when((gain >= 6) & (r < 0), "fake").when((gain >= 3) & (dd > -3), "mild").when(dd <= -6, "falling").otherwise("sideways")


def take_profit(bars: DataFrame, targets: tuple[float, ...] = (1.0, 2.0, 4.0), h: int = 20) -> DataFrame:
    """One row per target: the target if a high of the next h rows reaches it, else the return at h."""
    d = forward(bars, (h,)).where(F.col(f"r_{h}").isNotNull()).withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    hit = F.col(f"max_gain_{h}") >= F.col("target")
    return d.select(SYMBOL, DATE, "target", hit.alias("hit"), F.when(hit, F.col("target")).otherwise(F.col(f"r_{h}")).alias("outcome"))


def backfill(signals: DataFrame, bars: DataFrame, steps: tuple[int, ...] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """Close and return 1 to 20 rows after each signal's bar, and how many rows are there so far."""
    w = by_time()
    ahead = bars.select(SYMBOL, DATE, F.col("close").alias("close_0"), *(F.lead("close", s).over(w).alias(f"close_{s}") for s in steps), F.count("close").over(w.rowsBetween(1, 20)).alias("filled"))
    return signals.join(ahead, [SYMBOL, DATE]).select(*signals.columns, "filled", *((100 * (F.col(f"close_{s}") / F.col("close_0") - 1)).alias(f"ret_{s}") for s in steps))


# Buckets, ranks, selection -------------------------------------------------------------------------------


def bucket(x: Column, bounds: tuple[float, ...]) -> Column:
    """Number of bounds at or below x: half-open intervals, null for null."""
    out = F.when(x.isNull(), None)
    for k, b in enumerate(bounds):
        out = out.when(x < b, k)
    return out.otherwise(len(bounds))


def rank_bins(x: str, by: list[str], n: int = 5, ties: tuple[str, ...] = (SYMBOL, DATE)) -> Column:
    """1..n: equal-width bins of the rank of x within `by` (nulls out), ties in the order of `ties`."""
    some = F.col(x).isNotNull()
    w = Window.partitionBy(*by, some).orderBy(x, *ties)
    k, m = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*by, some))
    return F.when(some, F.greatest(F.lit(1), F.ceil((k - 1) / F.greatest(m - 1, F.lit(1)) * n)).cast("int"))


def rank_share(place: str, m: str, n: int = 5) -> Column:
    """1..n by the share of a place (from 1) among m rows: what `rank_bins` makes of its own window."""
    return F.greatest(F.lit(1), F.ceil((F.col(place) - 1) / F.greatest(F.col(m) - 1, F.lit(1)) * n)).cast("int")


def ranked_in_ranges(d: DataFrame, x: str, into: str, rows: int = 200_000, by: tuple[str, ...] = (), ties: tuple[str, ...] | None = None) -> DataFrame:
    """`d` with `into`, the rank of x among all rows (or within `by`), ties averaged; or with `ties`, its place in the order of x and these columns. Rows without x stay, with null.

    No window over everything: rows are dealt into ranges of x at approximate quantiles, so
    that equal values share a range, numbered inside a range, and shifted by the rows of
    the ranges before it: one small row for each range (and group). `d` is written once, in the shared folder.
    """
    d = kept(d, "ranks")
    parts = max(1, min(4096, d.count() // rows))
    at = F.lit(0)
    if parts > 1:
        bounds = sorted(set(d.stat.approxQuantile(x, [i / parts for i in range(1, parts)], 0.25 / parts)))
        cuts = F.array(*(F.lit(float(b)) for b in bounds))
        at = F.size(F.filter(cuts, lambda b: b <= F.col(x)))
    dealt = d.withColumn("__range", F.when(F.col(x).isNotNull(), at))
    counts = dealt.where("__range IS NOT NULL").groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    group = [*by, "__range"]
    if ties is None:
        place = F.rank().over(Window.partitionBy(*group).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, x)) - 1) / 2
    else:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(x, *ties))
    d = dealt.withColumn("__place", place).join(counts, group, "left")
    return d.withColumn(into, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def percentiles(d: DataFrame, x: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact, linearly interpolated percentiles of x over all rows, by name; the rows at their places come from ranges, no task holds all values."""
    ranked = ranked_in_ranges(d.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x")), "x", "k", ties=())
    ranked = ranked.join(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("n"))))  # one row
    at = {name: (F.col("n") - 1) * float(p) for name, p in shares.items()}
    part = {name: F.when(F.col("k") - 1 == F.floor(v), 1 - (v - F.floor(v))).when(F.col("k") - 1 == F.floor(v) + 1, v - F.floor(v)) for name, v in at.items()}
    return ranked.agg(*(F.sum(F.when(w > 0, F.col("x") * w)).alias(name) for name, w in part.items()))


def quantile_bins(d: DataFrame, x: str, by: list[str], n: int = 5, name: str = "bin") -> DataFrame:
    """1..n by linear-interpolated quantile edges within `by`, right-closed; edges are one small row per group, joined back."""
    edges = d.groupBy(*by).agg(F.expr(f"percentile({x}, array({', '.join(f'{k / n!r}D' for k in range(1, n))}))").alias("edges"))
    d = d.join(edges, by)
    return d.withColumn(name, F.when(F.col(x).isNotNull(), F.size(F.filter("edges", lambda e: e < F.col(x))) + 1)).drop("edges")


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def top_n(d: DataFrame, by: list[str], score: str, n: int, ties: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *ties)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def budget_fill(d: DataFrame, size: str, budget: float, by: list[str], order: list[Column], least: float = 0.005) -> DataFrame:
    """Rows in order until the budget is used; the last one is cut to what is left."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = d.withColumn("used", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return d.where(F.col("used") <= budget - least).withColumn("position", F.least(F.col(size), budget - F.col("used"))).drop("used")


def keep_last(d: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return d.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def as_of(left: DataFrame, right: DataFrame, values: list[str], key: str = SYMBOL, at: str = DATE) -> DataFrame:
    """Each left row with the latest right row of its key at or before its date: a union and one running window, no range join."""
    l = left.select("*", *(F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values), F.lit(None).cast("date").alias("as_of"), F.lit(1).alias("__side"))
    r = right.select(key, at, *values, F.col(at).alias("as_of"), F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    d = l.unionByName(r, allowMissingColumns=True)
    d = d.select(*(c for c in l.columns if c not in values and c not in ("as_of", "__side")), *(F.last(v, ignorenulls=True).over(w).alias(v) for v in [*values, "as_of"]), "__side")
    return d.where("__side = 1").drop("__side")


def segments(d: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Each row once for every named predicate that holds: overlapping segments in one pass."""
    named = F.array(*(F.when(m, F.lit(k)) for k, m in masks.items()))
    return d.withColumn("segment", F.explode(F.filter(named, lambda s: s.isNotNull())))


# Statistics ----------------------------------------------------------------------------------------------


def outcome(r: str = "r_20") -> list[Column]:
    x = F.col(r)
    return [F.count(x).alias("n"), F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)).alias("win_rate"), F.avg(x).alias("mean"), F.expr(f"percentile({r}, 0.5)").alias("median")]


def validity(d: DataFrame, factors: list[str], dims: list[str], r: str = "r_20") -> DataFrame:
    """Outcome of each factor's quintiles, over all and by each segment column, in one pass of grouping sets."""
    long = d.select(*dims, r, SYMBOL, DATE, F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors))).alias("x"))
    long = long.select(*dims, r, SYMBOL, DATE, "x.factor", "x.value").where(f"value IS NOT NULL AND {r} IS NOT NULL")
    long = ranked_in_ranges(long, "value", "place", by=("factor",), ties=(SYMBOL, DATE))
    long = long.join(F.broadcast(long.groupBy("factor").agg(F.count(F.lit(1)).alias("m"))), "factor")  # one row per factor
    long = long.withColumn("q", rank_share("place", "m"))
    sets = [["factor", "q"], *(["factor", "q", s] for s in dims)]
    return long.groupingSets([[F.col(c) for c in s] for s in sets], "factor", "q", *dims).agg(*outcome(r))


def information_coefficients(d: DataFrame, factors: list[str], labels: list[str], by: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of factors and labels within `by`: factor, label, n, ic, rank_ic."""
    pairs = [F.struct(F.lit(f).alias("factor"), F.lit(l).alias("label"), F.col(f).cast("double").alias("x"), F.col(l).cast("double").alias("y")) for f in factors for l in labels]
    long = d.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    keys = ["factor", "label", *by]
    ranked = long.withColumns({"rx": average_rank("x", keys), "ry": average_rank("y", keys)})
    # Null, not NaN, for a constant input.
    safe = lambda a, b: F.covar_pop(a, b) / F.nullif(F.round(F.stddev_pop(a) * F.stddev_pop(b), 12), F.lit(0.0))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe("x", "y").alias("ic"), safe("rx", "ry").alias("rank_ic"))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of the rows that have both; NaN, as in SQL, where either is constant (Spark's corr() divides by zero there), null without rows."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def auc(d: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by the rank-sum formula, ties averaged."""
    ranked = d.where(f"{score} IS NOT NULL AND {label} IS NOT NULL").withColumn("rk", average_rank(score, by) if by else average_rank(score, [F.lit(0)]))
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    n = F.count(F.lit(1))
    ranks = F.sum(F.when(F.col(label) == 1, F.col("rk")))
    return ranked.groupBy(*by).agg(n.alias("n"), pos.alias("positives"), ((ranks - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"))


def t_test(x: str) -> list[Column]:
    """One-sample t of the mean against 0."""
    n, m, s = F.count(x), F.avg(x), F.stddev_samp(x)
    return [n.alias("n"), m.alias("mean"), s.alias("sd"), (m / F.nullif(s / F.sqrt(n), F.lit(0.0))).alias("t")]


# Portfolios ----------------------------------------------------------------------------------------------


def nav(returns: DataFrame, by: list[str], r: str, order: str = DATE) -> DataFrame:
    """Compounded value, its peak so far and the drawdown; returns in percent."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("nav", F.exp(F.sum(F.log1p(F.col(r) / 100)).over(w)))
    d = d.withColumn("peak", F.max("nav").over(w))
    return d.withColumn("drawdown", F.col("nav") / F.greatest(F.col("peak"), F.lit(1.0)) - 1)


def performance(navs: DataFrame, by: list[str], r: str, per_year: float) -> DataFrame:
    m, s = F.avg(r), F.stddev_samp(r)
    return navs.groupBy(*by).agg(F.count(r).alias("periods"), m.alias("mean"), s.alias("sd"), (m / F.nullif(s, F.lit(0.0)) * per_year**0.5).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.max_by("nav", DATE).alias("final"))
