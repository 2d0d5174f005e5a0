"""More registered queries: selections, segment statistics, comparisons with benchmarks, the sparse layered score."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import panels as P
from .panel_queries import FACTS, STATS, facts, query, t
from .sources.fixtures import read

GUARD = "r_20 IS NOT NULL AND bias IS NOT NULL AND surge IS NOT NULL AND place IS NOT NULL"


TAILS = (("top1", 0.99), ("top5", 0.95), ("top10", 0.9))
_TAILS = " UNION ALL ".join(f"SELECT '{k}' AS part, k.* FROM k, q WHERE bias >= {k}" for k, _ in TAILS)


@query(f"{FACTS}, k AS (SELECT * FROM facts WHERE {GUARD}), q AS (SELECT {', '.join(f'quantile_cont(bias, {p}) AS {k}' for k, p in TAILS)} FROM k), s AS ({_TAILS} UNION ALL SELECT 'all', k.* FROM k) SELECT part, {STATS} FROM s GROUP BY part", "panel")
def ev13_top_tail(spark, sf_dir):
    """Outcome of the best 1, 5 and 10 % of all rows (ties at the threshold kept)."""
    d = facts(spark, sf_dir).where(GUARD)
    edges = P.percentiles(d, "bias", dict(TAILS))
    masks = {k: F.col("bias") >= F.col(k) for k, _ in TAILS} | {"all": F.lit(True)}
    return P.segments(d.crossJoin(F.broadcast(edges)), masks).groupBy(F.col("segment").alias("part")).agg(*P.outcome())


@query(f"{FACTS}, b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY trade_date) >= 5 THEN CAST(ceil((rank() OVER (PARTITION BY trade_date ORDER BY bias) + 0.0) * 5 / count(*) OVER (PARTITION BY trade_date)) AS INTEGER) END AS q FROM facts WHERE {GUARD}), m AS (SELECT q, avg(r_20) AS m, count(*) AS n FROM b GROUP BY q) SELECT q, n, {{m AS mean}}, coalesce(m > lag(m) OVER (ORDER BY q), true) AS rising FROM m", "panel")
def ev14_monotonicity(spark, sf_dir):
    w = Window.partitionBy("trade_date")
    n = F.count(F.lit(1)).over(w)
    d = facts(spark, sf_dir).where(GUARD).withColumn("q", F.when(n >= 5, F.ceil(F.rank().over(w.orderBy("bias")) * 5 / n).cast("int")))
    m = d.groupBy("q").agg(F.avg("r_20").alias("mean"), F.count(F.lit(1)).alias("n"))
    return m.select("q", "n", "mean", F.coalesce(F.col("mean") > F.lag("mean").over(Window.orderBy("q")), F.lit(True)).alias("rising"))


@query(f"{FACTS}, b AS (SELECT trade_date, avg(r_20) AS bench FROM facts WHERE r_20 IS NOT NULL GROUP BY trade_date) SELECT industry, count(*) AS n, {{avg(r_20 - bench) AS gross}}, {{avg(r_20 - bench) - 0.5 AS net}}, {{avg(CASE WHEN r_20 > bench THEN 1.0 ELSE 0.0 END) AS beat}} FROM facts JOIN b USING (trade_date) WHERE r_20 IS NOT NULL AND surge > 1.2 GROUP BY industry", "panel")
def ev09_segment_alpha(spark, sf_dir):
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL")
    bench = d.groupBy("trade_date").agg(F.avg("r_20").alias("bench"))
    j = d.where("surge > 1.2").join(bench, "trade_date")
    a = F.col("r_20") - F.col("bench")
    return j.groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("gross"), (F.avg(a) - 0.5).alias("net"), F.avg(F.when(a > 0, 1.0).otherwise(0.0)).alias("beat"))


@query(f"{FACTS} SELECT cap, count(*) AS n, {{avg(surge) AS mean}}, {{quantile_cont(surge, 0.95) AS p95}}, {{avg(CASE WHEN surge > 1.5 THEN 1.0 ELSE 0.0 END) AS trigger}}, {{avg(CASE WHEN surge > 1.5 THEN r_20 END) - avg(r_20) AS lift}} FROM facts WHERE {GUARD} GROUP BY cap", "panel")
def ev11_activation(spark, sf_dir):
    d = facts(spark, sf_dir).where(GUARD)
    hot = F.col("surge") > 1.5
    return d.groupBy("cap").agg(F.count(F.lit(1)).alias("n"), F.avg("surge").alias("mean"), F.expr("percentile(surge, 0.95D)").alias("p95"), F.avg(F.when(hot, 1.0).otherwise(0.0)).alias("trigger"), (F.avg(F.when(hot, F.col("r_20"))) - F.avg("r_20")).alias("lift"))


@query(f"{FACTS}, r AS (SELECT *, CASE WHEN NOT (bias > 0.02) THEN true ELSE false END AS kept FROM facts WHERE {GUARD}), u AS (SELECT 'all' AS variant, * FROM r UNION ALL SELECT 'without_overbought', * FROM r WHERE kept) SELECT variant, CAST(date_trunc('year', trade_date) AS DATE) AS year, {STATS} FROM u GROUP BY ALL", "panel")
def ev21_rule_ablation(spark, sf_dir):
    d = P.segments(facts(spark, sf_dir).where(GUARD), {"all": F.lit(True), "without_overbought": ~(F.col("bias") > 0.02)})
    return d.groupBy(F.col("segment").alias("variant"), F.to_date(F.date_trunc("year", "trade_date")).alias("year")).agg(*P.outcome())


@query(f"{FACTS} SELECT CAST(floor(place * 10) AS INTEGER) AS band, count(*) AS n, {{avg(r_20) AS long_return}}, {{-avg(r_20) AS short_return}} FROM facts WHERE {GUARD} GROUP BY floor(place * 10)", "panel")
def ev20_band_profile(spark, sf_dir):
    d = facts(spark, sf_dir).where(GUARD)
    return d.groupBy(F.floor(F.col("place") * 10).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("r_20").alias("long_return"), (-F.avg("r_20")).alias("short_return"))


@query("d AS (SELECT DISTINCT trade_date FROM bars), k AS (SELECT trade_date, row_number() OVER (PARTITION BY date_trunc('month', trade_date) ORDER BY trade_date) AS k FROM d) SELECT trade_date, CAST(k AS INTEGER) AS k FROM k WHERE k <= 2")
def rk11_first_dates(spark, sf_dir):
    d = t(spark, sf_dir, "bars").select("trade_date").distinct()
    return d.withColumn("k", F.row_number().over(Window.partitionBy(F.date_trunc("month", "trade_date")).orderBy("trade_date"))).where("k <= 2")


@query(f"{FACTS}, a AS (SELECT symbol, min(industry) AS industry, avg(total_mv) AS mv FROM facts GROUP BY symbol) SELECT industry, symbol, rank, {{mv AS mv}} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY industry ORDER BY mv DESC, symbol) AS INTEGER) AS rank FROM a) WHERE rank <= 3", "panel")
def rk10_group_leaders(spark, sf_dir):
    a = facts(spark, sf_dir).groupBy("symbol").agg(F.min("industry").alias("industry"), F.avg("total_mv").alias("mv"))
    return P.top_n(a, ["industry"], "mv", 3).select("industry", "symbol", "rank", "mv")


@query(f"{FACTS}, q AS (SELECT trade_date, quantile_cont(bias, 0.8) AS hi, quantile_cont(bias, 0.2) AS lo FROM facts WHERE {GUARD} GROUP BY trade_date) SELECT trade_date, {{avg(CASE WHEN bias >= hi THEN r_5 END) AS long_r}}, {{avg(CASE WHEN bias <= lo THEN r_5 END) AS short_r}}, {{avg(CASE WHEN bias >= hi THEN r_5 END) - avg(CASE WHEN bias <= lo THEN r_5 END) AS spread}} FROM facts JOIN q USING (trade_date) WHERE {GUARD} GROUP BY trade_date", "panel")
def pb01_long_short(spark, sf_dir):
    d = facts(spark, sf_dir).where(GUARD)
    q = d.groupBy("trade_date").agg(F.expr("percentile(bias, 0.8D)").alias("hi"), F.expr("percentile(bias, 0.2D)").alias("lo"))
    long, short = F.avg(F.when(F.col("bias") >= F.col("hi"), F.col("r_5"))), F.avg(F.when(F.col("bias") <= F.col("lo"), F.col("r_5")))
    return d.join(q, "trade_date").groupBy("trade_date").agg(long.alias("long_r"), short.alias("short_r"), (long - short).alias("spread"))


@query(f"{FACTS}, h AS (SELECT DISTINCT p_brand AS symbol, (CAST(split_part(p_brand, '#', 2) AS INTEGER) % 2 = 0) AS held FROM part) SELECT industry, held, {STATS} FROM facts JOIN h USING (symbol) GROUP BY industry, held", "panel")
def pb09_holder_comparison(spark, sf_dir):
    h = read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("held", F.element_at(F.split("symbol", "#"), 2).cast("int") % 2 == 0)
    return facts(spark, sf_dir).join(F.broadcast(h), "symbol").groupBy("industry", "held").agg(*P.outcome())


@query(f"{FACTS}, p AS (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY total_mv DESC, symbol) AS k FROM facts), top AS (SELECT trade_date, industry, avg(pe) AS peer_pe, count(*) AS peers FROM p WHERE k <= 3 GROUP BY ALL) SELECT symbol, trade_date, peers, {{peer_pe AS peer_pe}}, {{pe / nullif(peer_pe, 0) AS pe_ratio}} FROM facts JOIN top USING (trade_date, industry)", "panel")
def ag21_peers(spark, sf_dir):
    d = facts(spark, sf_dir)
    top = P.top_n(d, ["trade_date", "industry"], "total_mv", 3).groupBy("trade_date", "industry").agg(F.avg("pe").alias("peer_pe"), F.count(F.lit(1)).alias("peers"))
    return d.join(top, ["trade_date", "industry"]).select("symbol", "trade_date", "peers", "peer_pe", (F.col("pe") / F.nullif(F.col("peer_pe"), F.lit(0.0))).alias("pe_ratio"))


@query(f"{FACTS}, m AS (SELECT trade_date, quantile_cont(surge, 0.5) AS med FROM facts GROUP BY trade_date) SELECT trade_date, count(*) AS n, {{any_value(med) AS med}}, {{any_value(med) + 0.25 * sum(CASE WHEN abs(surge - med) > 0.4 THEN surge - med ELSE 0.0 END) / count(*) AS pulled}} FROM facts JOIN m USING (trade_date) GROUP BY trade_date", "panel")
def ag14_median_pull(spark, sf_dir):
    d = facts(spark, sf_dir)
    m = d.groupBy("trade_date").agg(F.expr("percentile(surge, 0.5D)").alias("med"))
    off = F.col("surge") - F.col("med")
    return d.join(m, "trade_date").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.first("med").alias("med"), (F.first("med") + 0.25 * F.sum(F.when(F.abs(off) > 0.4, off).otherwise(0.0)) / F.count(F.lit(1))).alias("pulled"))


SEG = "v AS (SELECT factor, q, cap, avg(y) AS m, count(*) AS n FROM (SELECT *, CAST(floor(x * 5) AS INTEGER) AS q FROM (SELECT 'place' AS factor, cap, place AS x, r_20 AS y FROM facts UNION ALL SELECT 'surge', cap, least(surge / 3, 0.999), r_20 FROM facts) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY ALL)"


@query(f"{FACTS}, {SEG}, l AS (SELECT symbol, trade_date, factor, cap, CAST(floor(x * 5) AS INTEGER) AS q FROM (SELECT symbol, trade_date, 'place' AS factor, cap, place AS x FROM facts UNION ALL SELECT symbol, trade_date, 'surge', cap, least(surge / 3, 0.999) FROM facts) WHERE x IS NOT NULL), s AS (SELECT symbol, trade_date, CASE WHEN n >= 20 AND abs(m) >= 0.1 THEN greatest(-20.0, least(20.0, 10 * m)) ELSE 0.0 END AS p FROM l JOIN v USING (factor, q, cap)) SELECT symbol, trade_date, {{50 + sum(p) AS score}}, {{sum(greatest(p, 0.0)) AS long_points}}, {{sum(greatest(-p, 0.0)) AS short_points}}, {{sum(greatest(p, 0.0)) * sum(greatest(-p, 0.0)) - sum(greatest(p, 0.0) * greatest(-p, 0.0)) AS conflict}} FROM s GROUP BY symbol, trade_date", "panel")
def sr10_sparse_layered_score(spark, sf_dir):
    """Each factor's value is looked up in its segment's table of outcomes; active cells add points, opposite ones conflict."""
    d = facts(spark, sf_dir)
    x = F.explode(F.array(F.struct(F.lit("place").alias("factor"), F.col("place").alias("x")), F.struct(F.lit("surge").alias("factor"), F.least(F.col("surge") / 3, F.lit(0.999)).alias("x"))))
    long = d.select("symbol", "trade_date", "cap", "r_20", x.alias("f")).select("symbol", "trade_date", "cap", "r_20", "f.factor", F.floor(F.col("f.x") * 5).cast("int").alias("q")).where("q IS NOT NULL")
    table = long.where("r_20 IS NOT NULL").groupBy("factor", "q", "cap").agg(F.avg("r_20").alias("m"), F.count(F.lit(1)).alias("n"))
    p = F.when((F.col("n") >= 20) & (F.abs("m") >= 0.1), F.greatest(F.lit(-20.0), F.least(F.lit(20.0), 10 * F.col("m")))).otherwise(0.0)
    s = long.join(table, ["factor", "q", "cap"]).withColumn("p", p)
    up, down = F.greatest("p", F.lit(0.0)), F.greatest(-F.col("p"), F.lit(0.0))
    return s.groupBy("symbol", "trade_date").agg((50 + F.sum("p")).alias("score"), F.sum(up).alias("long_points"), F.sum(down).alias("short_points"), (F.sum(up) * F.sum(down) - F.sum(up * down)).alias("conflict"))
