"""Registered queries of joins, sets, scalar families, state spells and label outcomes."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import panels as P
from .panel_queries import FACTS, STATS, W_, facts, lab, query, t
from .sources.fixtures import CTES, read

_MARKET = CTES["market"].split(",\nmarket AS ")[1]
MARKET = f"market AS {_MARKET}"


@query(f"{MARKET} SELECT symbol, trade_date, {{close AS close}}, {{mc AS market_close}}, {{100 * (close / mc - 1) AS gap}} FROM (SELECT b.*, m.close AS mc FROM bars b LEFT JOIN market m USING (trade_date))")
def jn02_market_by_date(spark, sf_dir):
    m = t(spark, sf_dir, "market").select("trade_date", F.col("close").alias("market_close"))
    return t(spark, sf_dir, "bars").join(m, "trade_date", "left").select("symbol", "trade_date", "close", "market_close", (100 * (F.col("close") / F.col("market_close") - 1)).alias("gap"))


@query("a AS (SELECT trade_date, close AS a FROM bars WHERE symbol = 'Brand#11'), b AS (SELECT trade_date, close AS b FROM bars WHERE symbol = 'Brand#12') SELECT trade_date, {a AS a}, {b AS b} FROM a FULL JOIN b USING (trade_date)")
def jn07_outer_benchmarks(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    one = lambda s, c: b.where(F.col("symbol") == s).select("trade_date", F.col("close").alias(c))
    return one("Brand#11", "a").join(one("Brand#12", "b"), "trade_date", "full")


@query(f"{CTES['signals']}, x AS (SELECT s.*, b.close FROM signals s LEFT JOIN (SELECT symbol, trade_date, close FROM bars WHERE vol > 100) b USING (symbol, trade_date)) SELECT o_orderkey, symbol, trade_date, {{coalesce(close, score) AS label}} FROM x")
def jn13_priority_label(spark, sf_dir):
    b = t(spark, sf_dir, "bars").where("vol > 100").select("symbol", "trade_date", "close")
    return t(spark, sf_dir, "signals").join(b, ["symbol", "trade_date"], "left").select("o_orderkey", "symbol", "trade_date", F.coalesce("close", "score").alias("label"))


@query("SELECT CAST(least(floor(score / 12.5), 7) AS INTEGER) AS bin, count(*) AS n, {avg(score) AS mean} FROM signals GROUP BY 1", "signals")
def ag05_score_bins(spark, sf_dir):
    return t(spark, sf_dir, "signals").groupBy(F.least(F.floor(F.col("score") / 12.5), F.lit(7)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


@query("SELECT symbol, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last, count(DISTINCT date_trunc('month', trade_date)) AS months FROM bars GROUP BY symbol")
def ag09_period_counts(spark, sf_dir):
    return t(spark, sf_dir, "bars").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count_distinct(F.date_trunc("month", "trade_date")).alias("months"))


@query(f"{FACTS}, d AS (SELECT trade_date, industry, avg(r_20) AS m FROM facts WHERE r_20 IS NOT NULL GROUP BY ALL) SELECT industry, count(*) AS dates, {{avg(m) AS mean}}, {{stddev_samp(m) AS sd}} FROM d GROUP BY industry", "panel")
def ag16_nested_groups(spark, sf_dir):
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").groupBy("trade_date", "industry").agg(F.avg("r_20").alias("m"))
    return d.groupBy("industry").agg(F.count(F.lit(1)).alias("dates"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def _ic(by: str) -> str:
    return f"{FACTS} SELECT {by}, count(bias + r_20) AS n, {{corr(bias, r_20) AS ic_bias}}, {{corr(surge, r_20) AS ic_surge}} FROM facts GROUP BY {by} HAVING count(bias + r_20) >= 50"


@query(_ic("cap"), "panel")
def ev02_layered_ic(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("cap").agg(F.count(F.col("bias") + F.col("r_20")).alias("n"), P.correlation("bias", "r_20").alias("ic_bias"), P.correlation("surge", "r_20").alias("ic_surge")).where("n >= 50")


@query(f"{FACTS} SELECT {', '.join('{corr(' + f'{f}, r_{h}) AS {f}_{h}' + '}' for f in ('bias', 'place', 'surge') for h in (5, 10, 20))} FROM facts", "panel")
def ev01_ic_matrix(spark, sf_dir):
    return facts(spark, sf_dir).agg(*(P.correlation(f, f"r_{h}").alias(f"{f}_{h}") for f in ("bias", "place", "surge") for h in (5, 10, 20)))


@query(f"{FACTS}, d AS (SELECT trade_date, covar_pop(bias, r_20) / nullif(round(stddev_pop(bias) * stddev_pop(r_20), 12), 0) AS ic FROM facts WHERE r_20 IS NOT NULL GROUP BY trade_date HAVING count(*) >= 10) SELECT count(ic) AS dates, {{avg(ic) AS mean}}, {{stddev_samp(ic) AS sd}}, {{avg(ic) / nullif(stddev_samp(ic), 0.0) AS icir}} FROM d", "panel")
def ev05_icir(spark, sf_dir):
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").groupBy("trade_date").agg((F.covar_pop("bias", "r_20") / F.nullif(F.round(F.stddev_pop("bias") * F.stddev_pop("r_20"), 12), F.lit(0.0))).alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return d.agg(F.count("ic").alias("dates"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"))


@query(f"{FACTS} SELECT CAST(date_trunc('year', trade_date) AS DATE) AS year, cap, {STATS} FROM facts WHERE surge > 1.2 GROUP BY ALL", "panel")
def ev10_stability(spark, sf_dir):
    return facts(spark, sf_dir).where("surge > 1.2").groupBy(F.to_date(F.date_trunc("year", "trade_date")).alias("year"), "cap").agg(*P.outcome())


@query(f"{FACTS}, q AS (SELECT trade_date, quantile_cont(surge, 0.8) AS cut FROM facts GROUP BY trade_date) SELECT symbol, trade_date, {{surge AS surge}} FROM facts JOIN q USING (trade_date) WHERE surge >= cut", "panel")
def rk07_top_fifth(spark, sf_dir):
    d = facts(spark, sf_dir)
    q = d.groupBy("trade_date").agg(F.expr("percentile(surge, 0.8D)").alias("cut"))
    return d.join(q, "trade_date").where("surge >= cut").select("symbol", "trade_date", "surge")


@query("a AS (SELECT DISTINCT symbol, 1 AS k FROM bars WHERE vol > 250), b AS (SELECT DISTINCT symbol, 2 AS k FROM bars WHERE high - low > 3), u AS (SELECT symbol, min(k) AS first_source, count(*) AS sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY symbol) SELECT symbol, first_source, sources FROM u")
def st06_union_of_pools(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    one = lambda c, k: b.where(c).select("symbol").distinct().withColumn("k", F.lit(k))
    return one("vol > 250", 1).unionByName(one("high - low > 3", 2)).groupBy("symbol").agg(F.min("k").alias("first_source"), F.count(F.lit(1)).alias("sources"))


@query("x AS ((SELECT symbol, trade_date FROM bars WHERE close > open) EXCEPT ALL (SELECT symbol, trade_date FROM bars WHERE vol < 150)) SELECT symbol, trade_date FROM x")
def st04_set_difference(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    return b.where("close > open").select("symbol", "trade_date").exceptAll(b.where("vol < 150").select("symbol", "trade_date"))


@query(f"m AS (SELECT symbol, trade_date, CASE WHEN round(close - avg(close) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) >= 0 THEN 'above' ELSE 'below' END AS state FROM bars), c AS (SELECT *, CASE WHEN state = lag(state) OVER ({W_}) THEN 0 ELSE 1 END AS c FROM m), b AS (SELECT *, sum(c) OVER ({W_}) AS block FROM c), g AS (SELECT symbol, state, block, min(trade_date) AS first, max(trade_date) AS last, count(*) AS n FROM b GROUP BY ALL) SELECT symbol, state, first, last, n, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, state ORDER BY n DESC, first) AS INTEGER) AS k FROM g) WHERE k <= 3")
def d14_longest_spells(spark, sf_dir):
    w = P.by_time()
    d = t(spark, sf_dir, "bars").withColumn("state", F.when(F.round(F.col("close") - F.avg("close").over(w.rowsBetween(-19, 0)), 9) >= 0, "above").otherwise("below"))
    d = d.withColumn("c", F.when(F.col("state") == F.lag("state").over(w), 0).otherwise(1)).withColumn("block", F.sum("c").over(w))
    g = d.groupBy("symbol", "state", "block").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("symbol", "state").orderBy(F.desc("n"), "first"))).where("k <= 3").select("symbol", "state", "first", "last", "n", "k")


@query(f"{lab('bars')} SELECT symbol, trade_date, CASE WHEN r_20 IS NULL THEN 'open' WHEN max_dd_20 <= -4 THEN 'stopped' WHEN max_gain_20 >= 4 THEN 'target' WHEN r_20 > 0 THEN 'right' ELSE 'wrong' END AS verdict FROM lab")
def l08_verdicts(spark, sf_dir):
    d = P.forward(t(spark, sf_dir, "bars"), (20,))
    v = F.when(F.col("r_20").isNull(), "open").when(F.col("max_dd_20") <= -4, "stopped").when(F.col("max_gain_20") >= 4, "target").when(F.col("r_20") > 0, "right").otherwise("wrong")
    return d.select("symbol", "trade_date", v.alias("verdict"))


@query("v AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: CAST(q.e[i] AS DOUBLE) * d.e[i])) / (q.n * d.n), 6) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id), b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0.1) SELECT query_id, doc_id, {score AS score}, rank FROM b WHERE rank <= 5")
def tx03_cosine(spark, sf_dir):
    from .operators import text

    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return text.cosine(v, v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")))


@query("SELECT o_orderkey, {ln(1 + o_totalprice) AS log_price}, {sign(o_totalprice - 100000) AS side}, upper(o_orderpriority) AS priority, substring(o_orderpriority, 3) AS name, CAST(extract(week FROM o_orderdate) AS INTEGER) AS week, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' ELSE 'low' END AS class FROM orders", "bars")
def sc05_scalar_functions(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return o.select("o_orderkey", F.log1p("o_totalprice").alias("log_price"), F.signum(F.col("o_totalprice") - 100000).alias("side"), F.upper(p).alias("priority"), F.expr("substring(o_orderpriority, 3)").alias("name"), F.weekofyear("o_orderdate").alias("week"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.when(p.rlike("^[12]"), "high").otherwise("low").alias("class"))
