"""Registered queries of labels, ranks, joins, aggregations, evaluation, scores and portfolios, each beside its checking SQL."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import panels as P
from .operators.spec import doubles, rounded
from .sources.fixtures import CTES, TABLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def rounding(d: DataFrame) -> DataFrame:
    return d.select(*(F.expr(rounded(f"`{c}`", DIGITS)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes))


def query(sql: str, source: str = "bars"):
    """Registers a function under its name with SQL over the source's CTEs; columns written as {x} in the SQL are rounded."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounding(f(spark, sf_dir))
        if sql:
            body = re.sub(r"\{([^{}]+) AS (\w+)\}", lambda m: f"{rounded(m[1], DIGITS)} AS {m[2]}", sql)
            ORACLE_SQL[f.__name__] = doubles(f"WITH {CTES[source]}{'' if body.startswith('SELECT') else ','}\n{body}")
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TABLES[name](spark, sf_dir)


W_ = "PARTITION BY symbol ORDER BY trade_date"


def _label(h: int) -> str:
    f = f"({W_} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    made = lambda x, name: f"CASE WHEN count(close) OVER {f} = {h} THEN 100 * ({x} / lead(open) OVER ({W_}) - 1) END AS {name}_{h}"
    return ", ".join((made(f"lead(close, {h}) OVER ({W_})", "r"), made(f"max(high) OVER {f}", "max_gain"), made(f"min(low) OVER {f}", "max_dd")))


#: Labels of the next 5, 10 and 20 rows: entry at the next open.
LAB = f"lab AS (SELECT *, {', '.join(map(_label, (5, 10, 20)))} FROM {{src}})"
FACT = f"fact AS (SELECT *, close / avg(close) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS bias, (close - min(low) OVER ({W_} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) / nullif(max(high) OVER ({W_} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - min(low) OVER ({W_} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0) AS place, vol / avg(vol) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS surge FROM lab)"


def lab(src: str) -> str:
    return LAB.replace("{src}", src)


def bucket_sql(x: str, bounds: tuple[float, ...]) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL {' '.join(f'WHEN {x} < {b} THEN {k}' for k, b in enumerate(bounds))} ELSE {len(bounds)} END)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with labels, three factors, cap and ratio buckets."""
    d = P.forward(t(spark, sf_dir, "panel"), (5, 10, 20))
    w = P.by_time()
    w20, w60 = w.rowsBetween(-19, 0), w.rowsBetween(-59, 0)
    lo, hi = F.min("low").over(w60), F.max("high").over(w60)
    d = d.withColumns({"bias": F.col("close") / F.avg("close").over(w20) - 1, "place": (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)), "surge": F.col("vol") / F.avg("vol").over(w20)})
    # Ranks below compare these values for ties: cut the noise of summation first.
    d = d.withColumns({c: F.expr(rounded(c, 9)) for c in ("bias", "place", "surge")})
    return d.withColumns({"cap": P.bucket(F.col("total_mv"), P.CAP_BOUNDS), "value": P.bucket(F.col("pe"), P.PE_BOUNDS)})


FACTS = f"{lab('panel')},\n{FACT},\nfacts AS (SELECT * REPLACE ({', '.join(f'{rounded(c, 9)} AS {c}' for c in ('bias', 'place', 'surge'))}), {bucket_sql('total_mv', P.CAP_BOUNDS)} AS cap, {bucket_sql('pe', P.PE_BOUNDS)} AS value FROM fact)"
STATS = "count(r_20) AS n, {avg(CASE WHEN r_20 > 0 THEN 1.0 WHEN r_20 IS NOT NULL THEN 0.0 END) AS win_rate}, {avg(r_20) AS mean}, {quantile_cont(r_20, 0.5) AS median}"


@query(f"{lab('bars')} SELECT symbol, trade_date, {', '.join('{' + f'{k}_{h} AS {k}_{h}' + '}' for h in (5, 10, 20) for k in ('r', 'max_gain', 'max_dd'))} FROM lab")
def l02_forward_labels(spark, sf_dir):
    d = P.forward(t(spark, sf_dir, "bars"), (5, 10, 20))
    return d.select("symbol", "trade_date", *(f"{k}_{h}" for h in (5, 10, 20) for k in ("r", "max_gain", "max_dd")))


@query(f"{lab('bars')} SELECT symbol, trade_date, coalesce(max_gain_20 >= 2.0 AND max_dd_20 > -1.0, false) AS is_clean, CASE WHEN max_gain_20 IS NULL THEN NULL WHEN max_gain_20 >= 6 AND max_dd_20 > -3 THEN 'strong' WHEN max_gain_20 >= 6 AND r_20 < 0 THEN 'fake' WHEN max_gain_20 >= 3 AND max_dd_20 > -3 THEN 'mild' WHEN max_dd_20 <= -6 THEN 'falling' ELSE 'sideways' END AS path FROM lab")
def l03_path_classes(spark, sf_dir):
    d = P.forward(t(spark, sf_dir, "bars"), (20,))
    return d.select("symbol", "trade_date", F.coalesce(P.is_clean(d), F.lit(False)).alias("is_clean"), P.path_class(d).alias("path"))


@query(f"{lab('bars')} SELECT symbol, trade_date, target, max_gain_20 >= target AS hit, {{CASE WHEN max_gain_20 >= target THEN target ELSE r_20 END AS outcome}} FROM lab, (SELECT unnest([1.0, 2.0, 4.0]) AS target) WHERE r_20 IS NOT NULL")
def l06_take_profit(spark, sf_dir):
    return P.take_profit(t(spark, sf_dir, "bars"))


@query("", "signals")
def l07_backfill(spark, sf_dir):
    return P.backfill(t(spark, sf_dir, "signals"), t(spark, sf_dir, "bars"))


@query(f"{lab('panel')} SELECT symbol, trade_date, {bucket_sql('total_mv', P.CAP_BOUNDS)} AS cap, {bucket_sql('pe', P.PE_BOUNDS)} AS value FROM lab", "panel")
def pr03_buckets(spark, sf_dir):
    return t(spark, sf_dir, "panel").select("symbol", "trade_date", P.bucket(F.col("total_mv"), P.CAP_BOUNDS).alias("cap"), P.bucket(F.col("pe"), P.PE_BOUNDS).alias("value"))


@query("q AS (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM bars) SELECT symbol, trade_date, {least(greatest(amount, lo), hi) AS amount} FROM bars, q")
def pr05_winsorise(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    edges = P.percentiles(b, "amount", {"lo": 0.01, "hi": 0.99})
    return b.crossJoin(F.broadcast(edges)).select("symbol", "trade_date", F.least(F.greatest("amount", "lo"), F.col("hi")).alias("amount"))


@query("q AS (SELECT quantile_cont(vol, 0.35) AS cut FROM bars) SELECT symbol, trade_date, {vol AS vol} FROM bars, q WHERE vol < cut")
def pr08_quantile_filter(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    return b.crossJoin(F.broadcast(P.percentiles(b, "vol", {"cut": 0.35}))).where("vol < cut").select("symbol", "trade_date", "vol")


@query(f"{FACTS}, seg AS (SELECT 'small' AS segment, * FROM facts WHERE cap = 0 UNION ALL SELECT 'cheap', * FROM facts WHERE pe > 0 AND pe < 30 UNION ALL SELECT 'surge', * FROM facts WHERE surge > 1.5 UNION ALL SELECT 'all', * FROM facts) SELECT segment, {STATS} FROM seg GROUP BY segment", "panel")
def pr09_segments(spark, sf_dir):
    d = facts(spark, sf_dir)
    masks = {"small": F.col("cap") == 0, "cheap": (F.col("pe") > 0) & (F.col("pe") < 30), "surge": F.col("surge") > 1.5, "all": F.lit(True)}
    return P.segments(d, masks).groupBy("segment").agg(*P.outcome())


@query("SELECT symbol, trade_date, {close AS close} FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n >= 160")
def pr11_minimum_history(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    return b.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where("n >= 160").select("symbol", "trade_date", "close")


@query("", "signals")
def jn06_as_of(spark, sf_dir):
    s = t(spark, sf_dir, "signals").select("o_orderkey", "symbol", F.date_add("trade_date", 3).alias("trade_date"))
    return P.as_of(s, t(spark, sf_dir, "bars"), ["close"]).select("o_orderkey", "symbol", "trade_date", "as_of", "close")


ORACLE_SQL["jn06_as_of"] = doubles(f"WITH {CTES['bars']},\n{CTES['signals']},\ns AS (SELECT o_orderkey, symbol, CAST(trade_date + INTERVAL 3 DAY AS DATE) AS d FROM signals), m AS (SELECT o_orderkey, s.symbol, d, max(b.trade_date) AS as_of FROM s LEFT JOIN bars b ON s.symbol = b.symbol AND b.trade_date <= s.d GROUP BY ALL) SELECT o_orderkey, m.symbol, d AS trade_date, as_of, {rounded('close', DIGITS)} AS close FROM m LEFT JOIN bars b ON b.symbol = m.symbol AND b.trade_date = m.as_of")
ORACLE_SQL["l07_backfill"] = doubles(f"WITH {CTES['bars']},\n{CTES['signals']},\na AS (SELECT symbol, trade_date, close AS c0, count(close) OVER ({W_} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS filled, " + ", ".join(f"lead(close, {s}) OVER ({W_}) AS c{s}" for s in (1, 2, 3, 5, 10, 20)) + f" FROM bars) SELECT o_orderkey, symbol, trade_date, {rounded('score', DIGITS)} AS score, filled, " + ", ".join(f"{rounded(f'(100 * (c{s} / c0 - 1))', DIGITS)} AS ret_{s}" for s in (1, 2, 3, 5, 10, 20)) + " FROM signals JOIN a USING (symbol, trade_date)")


@query("bands AS (SELECT unnest([0, 20, 40, 60, 80]) AS lo), x AS (SELECT lo, count(*) AS n, avg(score) AS s FROM signals JOIN bands ON score >= lo AND score < lo + 20 GROUP BY lo) SELECT lo, n, {s AS mean} FROM x", "signals")
def jn08_bands(spark, sf_dir):
    bands = spark.range(5).select((F.col("id") * 20).cast("int").alias("lo"))  # five rows, a fixed table of bands
    s = t(spark, sf_dir, "signals")
    j = s.join(F.broadcast(bands), (F.col("score") >= F.col("lo")) & (F.col("score") < F.col("lo") + 20))
    return j.groupBy("lo").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


@query("", "signals")
def jn05_semi_anti(spark, sf_dir):
    b, s = t(spark, sf_dir, "bars"), t(spark, sf_dir, "signals").where("score > 90").select("symbol", "trade_date")
    keys = ["symbol", "trade_date"]
    held = b.join(s, keys, "left_semi").withColumn("held", F.lit(True))
    return held.union(b.join(s, keys, "left_anti").withColumn("held", F.lit(False))).groupBy("symbol", "held").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"))


ORACLE_SQL["jn05_semi_anti"] = doubles(f"WITH {CTES['bars']},\n{CTES['signals']},\nx AS (SELECT *, EXISTS (SELECT 1 FROM signals s WHERE s.symbol = bars.symbol AND s.trade_date = bars.trade_date AND score > 90) AS held FROM bars) SELECT symbol, held, count(*) AS n, {rounded('avg(close)', DIGITS)} AS mean FROM x GROUP BY symbol, held")


@query("m AS (SELECT symbol, date_trunc('month', trade_date) AS month, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close, sum(vol) AS vol FROM bars GROUP BY ALL) SELECT symbol, CAST(month AS DATE) AS month, {open AS open}, {high AS high}, {low AS low}, {close AS close}, {vol AS vol}, {100 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1) AS pct_chg} FROM m")
def ag01_resample_monthly(spark, sf_dir):
    m = t(spark, sf_dir, "bars").groupBy("symbol", F.to_date(F.date_trunc("month", "trade_date")).alias("month")).agg(F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.sum("vol").alias("vol"))
    return m.withColumn("pct_chg", 100 * (F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("month")) - 1))


@query(f"{FACTS} SELECT cap, {STATS} FROM facts GROUP BY cap", "panel")
def ag03_outcome_by_cap(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("cap").agg(*P.outcome())


@query(f"{FACTS} SELECT cap, value, industry, grouping(cap, value, industry) AS level, {STATS} FROM facts GROUP BY GROUPING SETS ((), (cap), (value), (industry)) ", "panel")
def ag06_grouping_sets(spark, sf_dir):
    d = facts(spark, sf_dir)
    sets = [[], [F.col("cap")], [F.col("value")], [F.col("industry")]]
    return d.groupingSets(sets, "cap", "value", "industry").agg(F.grouping_id("cap", "value", "industry").alias("level"), *P.outcome())


@query(f"{FACTS}, c AS (SELECT industry, cap, value, count(r_20) AS n, avg(r_20) AS m FROM facts GROUP BY CUBE (industry, cap, value) HAVING count(r_20) >= 20) SELECT industry, cap, value, n, {{m AS mean}} FROM c", "panel")
def ag07_cube(spark, sf_dir):
    return facts(spark, sf_dir).cube("industry", "cap", "value").agg(F.count("r_20").alias("n"), F.avg("r_20").alias("mean")).where("n >= 20")


@query(f"{FACTS} SELECT industry, {', '.join(f'count(CASE WHEN cap = {k} THEN 1 END) AS cap_{k}' for k in range(5))} FROM facts GROUP BY industry", "panel")
def ag08_pivot(spark, sf_dir):
    d = facts(spark, sf_dir).groupBy("industry").pivot("cap", [0, 1, 2, 3, 4]).count()
    return d.select("industry", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"cap_{k}") for k in range(5)))


@query("SELECT symbol, count(*) AS n, {avg(close) AS mean}, {stddev_samp(close) AS sd}, {min(close) AS min}, {quantile_cont(close, 0.05) AS p5}, {quantile_cont(close, 0.5) AS p50}, {quantile_cont(close, 0.95) AS p95}, {max(close) AS max} FROM bars GROUP BY symbol")
def ag10_describe(spark, sf_dir):
    p = {f"p{k}": F.expr(f"percentile(close, {k / 100}D)") for k in (5, 50, 95)}
    return t(spark, sf_dir, "bars").groupBy("symbol").agg(F.count("close").alias("n"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"), F.min("close").alias("min"), *(e.alias(c) for c, e in p.items()), F.max("close").alias("max"))


@query("SELECT symbol, count(*) AS n_funds, {sum(weight) AS weight}, {max(weight) AS top_weight}, arg_max(fund, row(weight, fund)) AS top_fund FROM holdings GROUP BY symbol", "holdings")
def ag11_inverted_holdings(spark, sf_dir):
    return t(spark, sf_dir, "holdings").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_funds"), F.sum("weight").alias("weight"), F.max("weight").alias("top_weight"), F.max_by("fund", F.struct("weight", "fund")).alias("top_fund"))


@query("r AS (SELECT symbol, min(trade_date) AS first, max(trade_date) AS last, arg_min(close, trade_date) AS c0, arg_max(close, trade_date) AS c1 FROM bars WHERE trade_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY symbol) SELECT symbol, first, last, {100 * (c1 / c0 - 1) AS interval_return}, {100 * (power(c1 / c0, 365.0 / (last - first)) - 1) AS annual_return} FROM r")
def ag18_interval_return(spark, sf_dir):
    d = t(spark, sf_dir, "bars").where("trade_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'").groupBy("symbol").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.min_by("close", "trade_date").alias("c0"), F.max_by("close", "trade_date").alias("c1"))
    g = F.col("c1") / F.col("c0")
    return d.select("symbol", "first", "last", (100 * (g - 1)).alias("interval_return"), (100 * (F.pow(g, 365 / F.datediff("last", "first")) - 1)).alias("annual_return"))


@query(f"{FACTS} SELECT {{corr(bias, place) AS bias_place}}, {{corr(bias, surge) AS bias_surge}}, {{corr(place, surge) AS place_surge}} FROM facts", "panel")
def ag19_correlations(spark, sf_dir):
    return facts(spark, sf_dir).agg(*(P.correlation(a, b).alias(f"{a}_{b}") for a, b in (("bias", "place"), ("bias", "surge"), ("place", "surge"))))


QUINT = "CASE WHEN x IS NOT NULL THEN CAST(greatest(1, ceil((row_number() OVER (PARTITION BY f, x IS NOT NULL ORDER BY x, symbol, trade_date) - 1) / greatest(count(*) OVER (PARTITION BY f, x IS NOT NULL) - 1, 1) * 5)) AS INTEGER) END"


@query(f"{FACTS}, one AS (SELECT symbol, trade_date, 'bias' AS f, bias AS x FROM facts) SELECT symbol, trade_date, {QUINT} AS q FROM one", "panel")
def rk01_quintiles(spark, sf_dir):
    d = P.ranked_in_ranges(facts(spark, sf_dir).select("symbol", "trade_date", "bias"), "bias", "place", ties=("symbol", "trade_date"))
    d = d.join(F.broadcast(d.agg(F.count("bias").alias("m"))))  # one row
    return d.select("symbol", "trade_date", P.rank_share("place", "m").alias("q"))


@query(f"{FACTS}, e AS (SELECT trade_date, {', '.join(f'quantile_cont(bias, {k / 5}) AS e{k}' for k in range(1, 5))} FROM facts GROUP BY trade_date) SELECT symbol, trade_date, {' + '.join(f'CAST(e{k} < bias AS INTEGER)' for k in range(1, 5))} + 1 AS bin FROM facts JOIN e USING (trade_date)", "panel")
def rk02_date_quantiles(spark, sf_dir):
    return P.quantile_bins(facts(spark, sf_dir), "bias", ["trade_date"]).select("symbol", "trade_date", F.col("bin").cast("int").alias("bin"))


@query(f"{FACTS} SELECT symbol, trade_date, {{(rank() OVER (PARTITION BY trade_date, industry ORDER BY surge) + (count(*) OVER (PARTITION BY trade_date, industry, surge) - 1) / 2) / count(*) OVER (PARTITION BY trade_date, industry) AS pct}} FROM facts", "panel")
def rk04_industry_rank(spark, sf_dir):
    by = ["trade_date", "industry"]
    return facts(spark, sf_dir).select("symbol", "trade_date", (P.average_rank("surge", by) / F.count(F.lit(1)).over(Window.partitionBy(*by))).alias("pct"))


@query(f"{FACTS} SELECT trade_date, symbol, rank, {{surge AS surge}} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY surge DESC NULLS LAST, symbol) AS INTEGER) AS rank FROM facts) WHERE rank <= 3", "panel")
def rk05_top_per_date(spark, sf_dir):
    return P.top_n(facts(spark, sf_dir), ["trade_date"], "surge", 3).select("trade_date", "symbol", "rank", "surge")


@query(f"{FACTS} SELECT trade_date, symbol, industry FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY bias DESC NULLS LAST, symbol) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM facts) WHERE k <= greatest(2, floor(n * 0.1))", "panel")
def rk08_capped_selection(spark, sf_dir):
    w = Window.partitionBy("trade_date", "industry").orderBy(F.col("bias").desc_nulls_last(), "symbol")
    d = facts(spark, sf_dir).withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("trade_date"))})
    return d.where(F.col("k") <= F.greatest(F.lit(2), F.floor(F.col("n") * 0.1))).select("trade_date", "symbol", "industry")


@query(f"{FACTS}, s AS (SELECT *, least(0.05 + surge / 20, 0.12) AS size FROM facts), u AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY trade_date ORDER BY bias DESC NULLS LAST, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used FROM s) SELECT trade_date, symbol, {{least(size, 0.6 - used) AS position}} FROM u WHERE used <= 0.595", "panel")
def rk09_budget(spark, sf_dir):
    d = facts(spark, sf_dir).withColumn("size", F.least(0.05 + F.col("surge") / 20, F.lit(0.12)))
    return P.budget_fill(d, "size", 0.6, ["trade_date"], [F.col("bias").desc_nulls_last(), F.col("symbol")]).select("trade_date", "symbol", "position")


@query(f"{FACTS}, long AS (SELECT industry, cap, r_20, symbol, trade_date, 'bias' AS f, bias AS x FROM facts UNION ALL SELECT industry, cap, r_20, symbol, trade_date, 'place', place FROM facts UNION ALL SELECT industry, cap, r_20, symbol, trade_date, 'surge', surge FROM facts), k AS (SELECT *, {QUINT} AS q FROM long WHERE x IS NOT NULL AND r_20 IS NOT NULL) SELECT f AS factor, q, industry, cap, {STATS} FROM k GROUP BY GROUPING SETS ((f, q), (f, q, industry), (f, q, cap))", "panel")
def ev06_validity(spark, sf_dir):
    return P.validity(facts(spark, sf_dir), ["bias", "place", "surge"], ["industry", "cap"])


@query("", "panel")
def ev03_monthly_ic(spark, sf_dir):
    d = facts(spark, sf_dir).withColumn("month", F.to_date(F.date_trunc("month", "trade_date"))).withColumn("r_20", F.expr(rounded("r_20", 9)))
    return P.information_coefficients(d, ["bias", "place", "surge"], ["r_20"], ["month"]).select("factor", "month", "n", "ic", "rank_ic")


_LONG = " UNION ALL ".join(f"SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, '{f}' AS factor, {f} AS x, {rounded('r_20', 9)} AS y FROM facts" for f in ("bias", "place", "surge"))
ORACLE_SQL["ev03_monthly_ic"] = doubles(f"WITH {CTES['panel']},\n{FACTS}, ok AS (SELECT * FROM ({_LONG}) WHERE x IS NOT NULL AND y IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY factor, month ORDER BY x) + (count(*) OVER (PARTITION BY factor, month, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY factor, month ORDER BY y) + (count(*) OVER (PARTITION BY factor, month, y) - 1) / 2 AS ry FROM ok) SELECT factor, month, count(*) AS n, {rounded('(covar_pop(x, y) / nullif(round(stddev_pop(x) * stddev_pop(y), 12), 0))', DIGITS)} AS ic, {rounded('(covar_pop(rx, ry) / nullif(round(stddev_pop(rx) * stddev_pop(ry), 12), 0))', DIGITS)} AS rank_ic FROM rk GROUP BY factor, month")


@query(f"{FACTS}, b AS (SELECT industry, bias, CAST(r_20 > 0 AS INTEGER) AS y FROM facts WHERE r_20 IS NOT NULL AND bias IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY industry ORDER BY bias) + (count(*) OVER (PARTITION BY industry, bias) - 1) / 2 AS rk FROM b) SELECT industry, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {{(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc}} FROM k GROUP BY industry", "panel")
def ev15_auc(spark, sf_dir):
    d = facts(spark, sf_dir).withColumn("y", (F.col("r_20") > 0).cast("int"))
    return P.auc(d, "bias", "y", ["industry"])


@query(f"{FACTS}, a AS (SELECT f.industry, f.r_20 - avg(f.r_20) OVER (PARTITION BY f.trade_date) AS alpha FROM facts f WHERE r_20 IS NOT NULL) SELECT industry, count(alpha) AS n, {{avg(alpha) AS mean}}, {{stddev_samp(alpha) AS sd}}, {{avg(alpha) / nullif(stddev_samp(alpha) / sqrt(count(alpha)), 0.0) AS t}} FROM a GROUP BY industry", "panel")
def ev08_paired_alpha(spark, sf_dir):
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("alpha", F.col("r_20") - F.avg("r_20").over(Window.partitionBy("trade_date")))
    return d.groupBy("industry").agg(*P.t_test("alpha"))


NAV = "k AS (SELECT trade_date, symbol, r_5, row_number() OVER (PARTITION BY trade_date ORDER BY bias DESC NULLS LAST, symbol) AS rank FROM facts WHERE r_5 IS NOT NULL), p AS (SELECT trade_date, avg(r_5) AS r FROM k WHERE rank <= 5 GROUP BY trade_date), pick AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY trade_date) AS i FROM p) WHERE (i - 1) % 5 = 0), n AS (SELECT trade_date, r, exp(sum(ln(1 + r / 100)) OVER (ORDER BY trade_date)) AS nav FROM pick), m AS (SELECT *, max(nav) OVER (ORDER BY trade_date) AS peak FROM n)"


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return of the five of greatest bias, every fifth date."""
    top = P.top_n(facts(spark, sf_dir).where("r_5 IS NOT NULL"), ["trade_date"], "bias", 5)
    p = top.groupBy("trade_date").agg(F.avg("r_5").alias("r"))
    # One row per date: the windows below see dates only.
    return p.withColumn("i", F.row_number().over(Window.orderBy("trade_date"))).where("(i - 1) % 5 = 0").select("trade_date", "r", F.lit("top5").alias("book"))


@query(f"{FACTS}, {NAV} SELECT trade_date, {{r AS r}}, {{nav AS nav}}, {{nav / greatest(peak, 1.0) - 1 AS drawdown}} FROM m", "panel")
def pb03_equity_curve(spark, sf_dir):
    return P.nav(picks(spark, sf_dir), ["book"], "r").select("trade_date", "r", "nav", "drawdown")


@query(f"{FACTS}, {NAV} SELECT count(r) AS periods, {{avg(r) AS mean}}, {{stddev_samp(r) AS sd}}, {{avg(r) / nullif(stddev_samp(r), 0.0) * sqrt(10.4) AS sharpe}}, {{min(nav / greatest(peak, 1.0) - 1) AS max_drawdown}}, {{avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate}}, {{arg_max(nav, trade_date) AS final}} FROM m", "panel")
def pb02_performance(spark, sf_dir):
    return P.performance(P.nav(picks(spark, sf_dir), ["book"], "r"), ["book"], "r", 10.4).drop("book")
