"""Registered queries that complete earlier ones: further frames, horizons, tests and selections; the SQL beside each is written by itself."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import student
from .operators import panels as P
from .operators.spec import rounded
from .panel_queries import FACTS, STATS, W_, facts, lab, query, t
from .sources.fixtures import CTES

_SIGNALS = CTES["signals"].split("signals AS ")[1]
_BRANDS = CTES["signals"].split("signals AS ")[0]
_R9 = rounded("r_20", 9)


# Resampling, as-of, labels -----------------------------------------------------------------------------------


@query("w AS (SELECT symbol, CAST(date_trunc('week', trade_date) + INTERVAL 32 DAY AS DATE) AS friday, trade_date, open, high, low, close, vol FROM bars), m AS (SELECT symbol, CAST(date_trunc('month', trade_date) AS DATE) AS month, min(trade_date) AS first, max(trade_date) AS last FROM bars GROUP BY ALL), f AS (SELECT symbol, friday - 28 AS friday, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close, sum(vol) AS vol FROM w GROUP BY ALL) SELECT symbol, CAST(friday AS DATE) AS friday, {open AS open}, {high AS high}, {low AS low}, {close AS close}, {vol AS vol}, {lag(close) OVER (PARTITION BY symbol ORDER BY friday) AS pre_close} FROM f")
def ag01_resample_weekly(spark, sf_dir):
    """Weeks that end on Friday, with the close before."""
    d = t(spark, sf_dir, "bars").groupBy("symbol", F.date_sub(F.next_day(F.date_sub("trade_date", 1), "FRI"), 0).alias("friday")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.sum("vol").alias("vol")
    )
    return d.withColumn("pre_close", F.lag("close").over(Window.partitionBy("symbol").orderBy("friday")))


def latest(left: DataFrame, right: DataFrame, value: str, n: int, key: str = P.SYMBOL, at: str = P.DATE) -> DataFrame:
    """Each left row with the array of the n latest values of its key at or before its date, newest last: numbers of the right rows found as of the date, then one join on blocks of n rows."""
    w = Window.partitionBy(key).orderBy(at)
    numbered = right.select(key, at, value, F.row_number().over(w).alias("i")).withColumn("last", F.collect_list(value).over(w.rowsBetween(-(n - 1), 0)))
    return P.as_of(left, numbered, ["last"], key, at)


@query(f"{_BRANDS}signals AS {_SIGNALS}, s AS (SELECT o_orderkey, symbol, CAST(trade_date + INTERVAL 3 DAY AS DATE) AS d FROM signals), n AS (SELECT *, row_number() OVER ({W_}) AS i FROM bars), m AS (SELECT o_orderkey, s.symbol, max(i) AS i FROM s JOIN n ON s.symbol = n.symbol AND n.trade_date <= s.d GROUP BY ALL) SELECT o_orderkey, m.symbol, {{avg(close) FILTER (WHERE n.i > m.i - 10) AS mean_10}}, {{sum(CASE WHEN n.i = m.i THEN close WHEN n.i = m.i - 1 THEN -close END) AS change_2}}, count(CASE WHEN n.i > m.i - 10 THEN 1 END) AS n FROM m JOIN n ON n.symbol = m.symbol AND n.i BETWEEN m.i - 9 AND m.i GROUP BY o_orderkey, m.symbol")
def jn06_latest_rows(spark, sf_dir):
    """The two latest and the ten latest rows at or before a date."""
    s = t(spark, sf_dir, "signals").select("o_orderkey", "symbol", F.date_add("trade_date", 3).alias("trade_date"))
    d = latest(s, t(spark, sf_dir, "bars"), "close", 10).where("last IS NOT NULL")
    mean = F.aggregate("last", F.lit(0.0), lambda a, x: a + x) / F.size("last")
    two = F.when(F.size("last") > 1, F.element_at("last", -1) - F.try_element_at("last", F.lit(-2))).otherwise(F.element_at("last", -1))
    return d.select("o_orderkey", "symbol", mean.alias("mean_10"), two.alias("change_2"), F.size("last").cast("long").alias("n"))


#: Fixed values of the path classes: thresholds in percent, and rows in which an early peak counts.
PATH = {"dd": -5.0, "early_rows": 5, "early_peak": 3.0, "dump": -8.0, "mild": 15.0, "strong": 20.0, "aggressive": 25.0, "sideways_max": 12.0, "sideways_dd": -8.0, "flat": 0.001, "declines": 5}


def path_classes(bars: DataFrame, scale: float = 1.0, rows: int = 20) -> DataFrame:
    """fake_pump, aggressive, strong, mild, sideways or other by the next `rows` rows after entry at the next open; `scale` multiplies the percentages."""
    w = P.by_time()
    n = w.rowsBetween(1, rows)
    ma5 = F.avg("close").over(w.rowsBetween(-4, 0))
    d = bars.withColumns({"entry": F.lead("open").over(w), "ma5": F.round(ma5, 9)})
    d = d.withColumns({"h": F.collect_list("high").over(n), "l": F.collect_list("low").over(n), "m": F.collect_list("ma5").over(n)}).where(F.size("h") == rows)
    pct = lambda x: 100 * (x / F.col("entry") - 1)
    k = {x: v * scale if x not in ("early_rows", "declines", "flat") else v for x, v in PATH.items()}
    early = F.slice("h", 1, PATH["early_rows"])
    peak = F.array_position(early, F.array_max(early)).cast("int")
    d = d.withColumns({"gain": pct(F.array_max("h")), "dd": pct(F.array_min("l")), "early": pct(F.array_max(early)), "peak": peak})
    after = F.slice("l", F.col("peak") + 1, F.lit(rows) - F.col("peak"))
    dump = F.col("peak") + F.array_position(F.transform(after, lambda x: pct(x) <= k["dump"]), True).cast("int")
    d = d.withColumns({"fell": F.exists(after, lambda x: pct(x) <= k["dump"]), "dump": dump})
    back = F.array_max(F.slice("h", F.col("dump") + 1, F.greatest(F.lit(0), F.lit(rows) - F.col("dump"))))
    changes = F.transform(F.sequence(F.lit(1), F.lit(rows - 1)), lambda i: F.get("m", i) / F.get("m", i - 1) - 1 < -PATH["flat"])
    run = F.aggregate(changes, F.struct(F.lit(0).alias("now"), F.lit(0).alias("max")), lambda a, x: F.struct(F.when(x, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["max"], F.when(x, a["now"] + 1).otherwise(0)).alias("max")), lambda a: a["max"])
    fake = (F.col("early") >= k["early_peak"]) & F.col("fell") & (F.col("dump") < rows) & (pct(back) < 0)
    steady = (F.col("dd") >= k["dd"]) & (run < PATH["declines"])
    label = F.when(fake, "fake_pump").when(steady & (F.col("gain") >= k["aggressive"]), "aggressive").when(steady & (F.col("gain") >= k["strong"]), "strong").when(steady & (F.col("gain") >= k["mild"]), "mild")
    return d.withColumn("label", label.when((F.col("gain") < k["sideways_max"]) & (F.col("dd") > k["sideways_dd"]), "sideways").otherwise("other")).withColumn("declines", run)


_S = 0.2


@query(f"a AS (SELECT *, round(avg(close) OVER ({W_} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS ma5 FROM bars), b AS (SELECT symbol, trade_date, lead(open) OVER ({W_}) AS e, list(high) OVER n AS h, list(low) OVER n AS l, list(ma5) OVER n AS m FROM a WINDOW n AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)), c AS (SELECT *, list_transform(h, lambda x: 100 * (x / e - 1)) AS hp, list_transform(l, lambda x: 100 * (x / e - 1)) AS lp FROM b WHERE len(h) = 20), d AS (SELECT *, list_max(hp) AS gain, list_min(lp) AS dd, list_max(hp[1:5]) AS early, list_position(h, list_max(h[1:5])) AS pk FROM c), f AS (SELECT *, list_filter(range(1, 21), lambda i: i > pk AND lp[i] <= {-8 * _S}) AS dumps FROM d), g AS (SELECT *, dumps[1] AS dp, len(list_filter(range(6, 21), lambda i: len(list_filter(range(0, 5), lambda j: m[i - j] / m[i - j - 1] - 1 < -0.001)) = 5)) = 0 AS steady FROM f) SELECT symbol, trade_date, CASE WHEN early >= {3 * _S} AND dp IS NOT NULL AND dp < 20 AND list_max(hp[dp + 1:20]) < 0 THEN 'fake_pump' WHEN dd >= {-5 * _S} AND steady AND gain >= {25 * _S} THEN 'aggressive' WHEN dd >= {-5 * _S} AND steady AND gain >= {20 * _S} THEN 'strong' WHEN dd >= {-5 * _S} AND steady AND gain >= {15 * _S} THEN 'mild' WHEN gain < {12 * _S} AND dd > {-8 * _S} THEN 'sideways' ELSE 'other' END AS label FROM g")
def l03_six_classes(spark, sf_dir):
    return path_classes(t(spark, sf_dir, "bars"), _S).select("symbol", "trade_date", "label")


@query(f"b AS (SELECT symbol, trade_date, lead(open) OVER ({W_}) AS e, list(high) OVER n AS h, lead(close, 20) OVER ({W_}) AS c FROM bars WINDOW n AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)), x AS (SELECT *, list_filter(range(1, 21), lambda i: h[i] >= e * 1.02)[1] AS d FROM b WHERE c IS NOT NULL) SELECT symbol, trade_date, CAST(coalesce(d, 20) AS INTEGER) AS hold, d IS NOT NULL AS hit, {{CASE WHEN d IS NOT NULL THEN 2.0 ELSE 100 * (c / e - 1) END AS outcome}} FROM x")
def l06_hit_day(spark, sf_dir):
    """The first of 20 rows whose high reaches 2 % over the entry, the exit there, or the close of the last row."""
    w = P.by_time()
    d = t(spark, sf_dir, "bars").withColumns({"e": F.lead("open").over(w), "h": F.collect_list("high").over(w.rowsBetween(1, 20)), "c": F.lead("close", 20).over(w)}).where("c IS NOT NULL")
    day = F.array_position(F.transform("h", lambda x: x >= F.col("e") * 1.02), True).cast("int")
    return d.withColumn("d", day).select("symbol", "trade_date", F.when(F.col("d") > 0, F.col("d")).otherwise(20).alias("hold"), (F.col("d") > 0).alias("hit"), F.when(F.col("d") > 0, 2.0).otherwise(100 * (F.col("c") / F.col("e") - 1)).alias("outcome"))


@query(f"{_BRANDS}signals AS {_SIGNALS}, a AS (SELECT symbol, trade_date, close, count(*) OVER n AS filled, min(low) OVER n AS lo, max(high) OVER n AS hi FROM bars WINDOW n AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) SELECT o_orderkey, symbol, filled, {{100 * (lo / close - 1) AS min_ret}}, {{100 * (hi / close - 1) AS max_ret}}, CASE WHEN score >= 65 THEN 'high' WHEN score >= 35 THEN 'middle' ELSE 'low' END AS band, CASE WHEN filled < 20 THEN 'open' WHEN score >= 50 THEN CASE WHEN lo / close - 1 <= -0.03 THEN 'stopped' WHEN hi / close - 1 >= 0.03 THEN 'target' ELSE 'held' END ELSE CASE WHEN hi / close - 1 >= 0.03 THEN 'wrong' WHEN lo / close - 1 <= -0.03 THEN 'right' ELSE 'flat' END END AS verdict FROM signals JOIN a USING (symbol, trade_date)")
def l08_band_verdicts(spark, sf_dir):
    """Extremes of the 20 rows after a signal, its band, and the verdict by the direction that its score calls for."""
    n = P.by_time().rowsBetween(1, 20)
    a = t(spark, sf_dir, "bars").select("symbol", "trade_date", "close", F.count(F.lit(1)).over(n).alias("filled"), F.min("low").over(n).alias("lo"), F.max("high").over(n).alias("hi"))
    d = t(spark, sf_dir, "signals").join(a, ["symbol", "trade_date"])
    down, up, s = F.col("lo") / F.col("close") - 1, F.col("hi") / F.col("close") - 1, F.col("score")
    long = F.when(down <= -0.03, "stopped").when(up >= 0.03, "target").otherwise("held")
    short = F.when(up >= 0.03, "wrong").when(down <= -0.03, "right").otherwise("flat")
    verdict = F.when(F.col("filled") < 20, "open").when(s >= 50, long).otherwise(short)
    return d.select("o_orderkey", "symbol", "filled", (100 * down).alias("min_ret"), (100 * up).alias("max_ret"), F.when(s >= 65, "high").when(s >= 35, "middle").otherwise("low").alias("band"), verdict.alias("verdict"))


# Profiles ----------------------------------------------------------------------------------------------------

_H = (5, 10, 20)


@query(f"{FACTS}, l AS ({' UNION ALL '.join(f'SELECT cap, {h} AS horizon, r_{h} AS r, max_dd_{h} AS dd FROM facts' for h in _H)}) SELECT cap, horizon, count(r) AS n, {{avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS win_rate}}, {{avg(r) AS mean}}, {{quantile_cont(r, 0.5) AS median}}, {{avg(dd) AS drawdown}} FROM l GROUP BY ALL", "panel")
def ag03_outcome_by_horizon(spark, sf_dir):
    rows = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"r_{h}").alias("r"), F.col(f"max_dd_{h}").alias("dd")) for h in _H))
    d = facts(spark, sf_dir).select("cap", F.explode(rows).alias("x")).select("cap", "x.*")
    return d.groupBy("cap", "horizon").agg(*P.outcome("r"), F.avg("dd").alias("drawdown"))


_EDGES = (5, 10, 20, 30, 40, 45, 50, 55, 60, 70, 80, 90, 95)


@query(f"SELECT CAST({' + '.join(f'CAST(score >= {e} AS INTEGER)' for e in _EDGES)} AS INTEGER) AS bin, count(*) AS n, {{avg(score) AS mean}} FROM signals GROUP BY 1", "signals")
def ag05_fourteen_bins(spark, sf_dir):
    return t(spark, sf_dir, "signals").groupBy(P.bucket(F.col("score"), _EDGES).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


@query(f"{FACTS}, c AS (SELECT industry, cap, value, count(r_20) AS n, avg(r_20) AS m FROM facts GROUP BY ALL HAVING count(r_20) >= 20) SELECT industry, arg_max(cap, row(round(m, 9), cap, value)) AS cap, arg_max(value, row(round(m, 9), cap, value)) AS value, {{max(m) AS mean}}, count(*) AS cells FROM c GROUP BY industry", "panel")
def ag07_best_cells(spark, sf_dir):
    c = facts(spark, sf_dir).groupBy("industry", "cap", "value").agg(F.count("r_20").alias("n"), F.avg("r_20").alias("m")).where("n >= 20")
    order = F.struct(F.round("m", 9), "cap", "value")
    return c.groupBy("industry").agg(F.max_by("cap", order).alias("cap"), F.max_by("value", order).alias("value"), F.max("m").alias("mean"), F.count(F.lit(1)).alias("cells"))


@query("SELECT symbol, string_agg(CAST(fund AS VARCHAR) || ':' || CAST(k AS VARCHAR), ',' ORDER BY fund) AS holders, count(DISTINCT fund) AS n FROM holdings GROUP BY symbol", "holdings")
def ag11_holders(spark, sf_dir):
    """The inverted index: per symbol the list of its holders with their rank, as text."""
    h = t(spark, sf_dir, "holdings").groupBy("symbol").agg(F.array_sort(F.collect_set(F.struct("fund", "k"))).alias("list"))
    return h.select("symbol", F.array_join(F.transform("list", lambda x: F.concat_ws(":", x["fund"], x["k"])), ",").alias("holders"), F.size("list").cast("long").alias("n"))


_PAIRS = (("bias", "place"), ("bias", "surge"), ("place", "surge"))


@query(f"{FACTS}, ok AS (SELECT bias, place, surge FROM facts WHERE bias IS NOT NULL AND place IS NOT NULL AND surge IS NOT NULL), r AS (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}' for c in ('bias', 'place', 'surge'))} FROM ok), p AS ({' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS a, {chr(39)}{b}{chr(39)} AS b, (SELECT corr({a}, {b}) FROM ok) AS pearson, (SELECT corr({a}, {b}) FROM r) AS spearman' for a, b in _PAIRS)}) SELECT a, b, {{pearson AS pearson}}, {{spearman AS spearman}}, abs(pearson) >= 0.3 OR abs(spearman) >= 0.3 AS close FROM p", "panel")
def ag19_pairs(spark, sf_dir):
    """Pearson and Spearman correlations of all pairs, with a mark from a bound on; ranks over everything come from ranges."""
    d = facts(spark, sf_dir).dropna(subset=["bias", "place", "surge"]).select("symbol", "trade_date", "bias", "place", "surge")
    for c in ("bias", "place", "surge"):
        d = P.ranked_in_ranges(d, c, f"r_{c}")
    out = d.agg(*(P.correlation(x + a, x + b).alias(f"{x}{a}_{b}") for a, b in _PAIRS for x in ("", "r_")))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("pearson"), F.col(f"r_{a}_{b}").alias("spearman")) for a, b in _PAIRS))
    return out.select(F.explode(rows).alias("x")).select("x.*", ((F.abs("x.pearson") >= 0.3) | (F.abs("x.spearman") >= 0.3)).alias("close"))


@query("l AS (SELECT symbol, industry, arg_max(total_mv, trade_date) AS mv, arg_max(pe, trade_date) AS pe FROM panel GROUP BY ALL), p AS (SELECT a.symbol, a.industry, a.mv, a.pe, b.symbol AS peer, b.mv AS pmv, b.pe AS ppe, row_number() OVER (PARTITION BY a.symbol ORDER BY b.mv DESC, b.symbol) AS k FROM l a JOIN l b ON a.industry = b.industry AND a.symbol <> b.symbol) SELECT symbol, {avg(ppe) AS peer_pe}, {(sum(ppe) + any_value(pe)) / (count(*) + 1) AS mean_pe}, {any_value(mv) / avg(pmv) AS mv_ratio}, string_agg(peer, ',' ORDER BY k) AS peers FROM p WHERE k <= 5 GROUP BY symbol", "panel")
def ag21_five_peers(spark, sf_dir):
    """The five largest of a symbol's industry, itself excluded: the industry's six largest, less itself or the sixth."""
    l = t(spark, sf_dir, "panel").groupBy("symbol", "industry").agg(F.max_by("total_mv", "trade_date").alias("mv"), F.max_by("pe", "trade_date").alias("pe"))
    six = P.top_n(l, ["industry"], "mv", 6).groupBy("industry").agg(F.array_sort(F.collect_list(F.struct("rank", "symbol", "mv", "pe"))).alias("six"))
    d = l.join(six, "industry").withColumn("five", F.slice(F.filter("six", lambda x: x["symbol"] != F.col("symbol")), 1, 5))
    total = lambda c: F.aggregate("five", F.lit(0.0), lambda a, x: a + x[c])
    n = F.size("five")
    return d.select("symbol", (total("pe") / n).alias("peer_pe"), ((total("pe") + F.col("pe")) / (n + 1)).alias("mean_pe"), (F.col("mv") / (total("mv") / n)).alias("mv_ratio"), F.array_join(F.transform("five", lambda x: x["symbol"]), ",").alias("peers"))


@query(f"{FACTS}, q AS (SELECT trade_date, quantile_cont(surge, 0.8) AS hi, quantile_cont(surge, 0.2) AS lo FROM facts GROUP BY trade_date) SELECT symbol, trade_date, CASE WHEN surge >= hi THEN 'top' ELSE 'bottom' END AS side FROM facts JOIN q USING (trade_date) WHERE surge >= hi OR surge <= lo", "panel")
def rk07_both_fifths(spark, sf_dir):
    d = facts(spark, sf_dir)
    q = d.groupBy("trade_date").agg(F.expr("percentile(surge, array(0.2D, 0.8D))").alias("q"))
    d = d.join(q, "trade_date").where((F.col("surge") >= F.get("q", 1)) | (F.col("surge") <= F.get("q", 0)))
    return d.select("symbol", "trade_date", F.when(F.col("surge") >= F.get("q", 1), "top").otherwise("bottom").alias("side"))


@query("SELECT symbol, trade_date, source, {close AS close} FROM (SELECT *, CASE WHEN day(trade_date) % 2 = 0 THEN 2 ELSE 1 END AS source FROM bars)")
def st03_kept_source(spark, sf_dir):
    """Bars of a first source and patched ones of a second; the last source that has a bar wins, and its name is returned."""
    b = t(spark, sf_dir, "bars").select("symbol", "trade_date", "close")
    first = b.select("symbol", "trade_date", F.when(F.dayofmonth("trade_date") % 2 == 0, F.lit(-1.0)).otherwise(F.col("close")).alias("close"), F.lit(1).alias("source"))
    second = b.where(F.dayofmonth("trade_date") % 2 == 0).select("symbol", "trade_date", "close", F.lit(2).alias("source"))
    return P.keep_last(first.unionByName(second), ["symbol", "trade_date"], [F.desc("source")]).select("symbol", "trade_date", "source", "close")


# Evaluation ----------------------------------------------------------------------------------------------------


def _tail_sql(x: str, n: str) -> str:
    """Two-sided p of t = x for whole degrees of freedom n, by the finite series of sines and cosines."""
    angle = f"atan(abs({x}) / sqrt({n}))"
    odd = f"2 / pi() * ({angle} + CASE WHEN {n} > 1 THEN sin({angle}) * cos({angle}) * sqrt(pi()) / 2 * list_sum(list_transform(range(CAST(({n} - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + 2 * k * ln(cos({angle}))))) ELSE 0 END)"
    even = f"sin({angle}) / sqrt(pi()) * list_sum(list_transform(range(CAST({n} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + 2 * k * ln(cos({angle})))))"
    return f"(1 - CASE WHEN {n} % 2 = 1 THEN {odd} ELSE {even} END)"


_ALPHA = "a AS (SELECT industry, cap, r_20, r_20 - avg(r_20) OVER (PARTITION BY trade_date) AS alpha FROM facts WHERE r_20 IS NOT NULL)"
_SIDE = lambda c: f"avg(r_20) FILTER (WHERE cap {c}) AS m, count(*) FILTER (WHERE cap {c}) AS n, var_samp(r_20) FILTER (WHERE cap {c}) / count(*) FILTER (WHERE cap {c}) AS e"


@query(f"{FACTS}, {_ALPHA}, g1 AS (SELECT industry, count(*) AS n, avg(alpha) AS m, avg(alpha) / nullif(stddev_samp(alpha) / sqrt(count(*)), 0) AS t, avg(CASE WHEN round(alpha, 9) > 0 THEN 1.0 ELSE 0.0 END) AS w FROM a GROUP BY industry), lo AS (SELECT industry, {_SIDE('<= 1')} FROM a GROUP BY industry), hi AS (SELECT industry, {_SIDE('> 1')} FROM a GROUP BY industry), g AS (SELECT g1.*, (lo.m - hi.m) / nullif(sqrt(lo.e + hi.e), 0) AS t2, floor(round(power(lo.e + hi.e, 2) / (lo.e * lo.e / (lo.n - 1) + hi.e * hi.e / (hi.n - 1)), 6)) AS f2 FROM g1 JOIN lo USING (industry) JOIN hi USING (industry)) SELECT industry, n, {{m AS mean}}, {{t AS t}}, {{{_tail_sql('t', '(n - 1)')} AS p}}, {{CASE WHEN t > 0 THEN {_tail_sql('t', '(n - 1)')} / 2 ELSE 1 - {_tail_sql('t', '(n - 1)')} / 2 END AS p_one}}, {{t2 AS t_two}}, {{f2 AS freedom_two}}, {{{_tail_sql('t2', 'f2')} AS p_two}}, {{w AS wins}} FROM g", "panel")
def ev08_tests(spark, sf_dir):
    """t of paired alpha with its two- and one-sided p, the two-sample t of small against large with whole degrees of freedom for unequal variances, and the share of wins."""
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("alpha", F.col("r_20") - F.avg("r_20").over(Window.partitionBy("trade_date")))
    side = {"a": F.when(F.col("cap") <= 1, F.col("r_20")), "b": F.when(F.col("cap") > 1, F.col("r_20"))}
    g = d.groupBy("industry").agg(*P.t_test("alpha"), *(f.alias(f"{c}_{k}") for k, x in side.items() for c, f in (("m", F.avg(x)), ("n", F.count(x)), ("e", F.var_samp(x) / F.count(x)))), F.avg(F.when(F.round("alpha", 9) > 0, 1.0).otherwise(0.0)).alias("wins"))
    ea, eb = F.col("e_a"), F.col("e_b")
    g = g.withColumns({"t_two": (F.col("m_a") - F.col("m_b")) / F.nullif(F.sqrt(ea + eb), F.lit(0.0)), "freedom_two": F.floor(F.round((ea + eb) * (ea + eb) / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1)), 6)).cast("double")})
    t, n = F.col("t"), F.col("n") - 1
    return g.select("industry", "n", "mean", "t", student.two_sided(t, n).alias("p"), student.one_sided(t, n).alias("p_one"), "t_two", "freedom_two", student.two_sided(F.col("t_two"), F.col("freedom_two")).alias("p_two"), "wins")


@query(f"{FACTS}, ok AS (SELECT trade_date, bias AS x, {_R9} AS y FROM facts WHERE r_20 IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY trade_date ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, y) - 1) / 2 AS ry FROM ok), d AS (SELECT trade_date, count(*) AS n, covar_pop(x, y) / nullif(round(stddev_pop(x) * stddev_pop(y), 12), 0) AS ic, covar_pop(rx, ry) / nullif(round(stddev_pop(rx) * stddev_pop(ry), 12), 0) AS ric FROM rk GROUP BY trade_date), b AS (SELECT least(9, floor((x + 0.05) * 100)) AS bx, least(9, floor((y + 5))) AS yb FROM ok), j AS (SELECT bx, yb, count(*) / sum(count(*)) OVER () AS p FROM b GROUP BY ALL), mi AS (SELECT sum(p * ln(p / (px * py))) AS mi FROM (SELECT p, sum(p) OVER (PARTITION BY bx) AS px, sum(p) OVER (PARTITION BY yb) AS py FROM j)) SELECT {{avg(ic) AS ic}}, {{avg(ric) AS rank_ic}}, {{avg(ic) / stddev_samp(ic) AS icir}}, {{avg(ric) / stddev_samp(ric) AS rank_icir}}, {{(SELECT mi FROM mi) AS mutual_information}} FROM d WHERE n >= 10", "panel")
def ev05_five_metrics(spark, sf_dir):
    """IC, rank IC and their ratios over dates, and mutual information by counts of a grid of ten by ten bins of fixed width."""
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("r_20", F.expr(_R9))
    by_date = P.information_coefficients(d, ["bias"], ["r_20"], ["trade_date"]).where("n >= 10")
    ir = lambda c: F.avg(c) / F.stddev_samp(c)
    four = by_date.agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), ir("ic").alias("icir"), ir("rank_ic").alias("rank_icir"))
    cells = d.groupBy(F.least(F.lit(9), F.floor((F.col("bias") + 0.05) * 100)).alias("x"), F.least(F.lit(9), F.floor(F.col("r_20") + 5)).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    # A grid's cells from here on: some dozens of rows.
    every = Window.partitionBy(F.lit(0))
    p = F.col("n") / F.sum("n").over(every)
    cells = cells.withColumn("p", p).withColumns({"px": F.sum("p").over(Window.partitionBy("x")), "py": F.sum("p").over(Window.partitionBy("y"))})
    return four.join(F.broadcast(cells.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mutual_information"))))


@query(f"{FACTS}, ok AS (SELECT industry, bias, CAST(r_20 > 1 AS INTEGER) AS y, symbol, trade_date FROM facts WHERE r_20 IS NOT NULL), k AS (SELECT *, row_number() OVER w AS k, sum(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM ok WINDOW w AS (PARTITION BY industry ORDER BY bias DESC, symbol, trade_date)) SELECT industry, {{sum(CASE WHEN y = 1 THEN tp / k END) / sum(y) AS average_precision}}, {{avg(CAST(y AS DOUBLE)) AS base}}, {{avg(CAST(y AS DOUBLE)) FILTER (WHERE k <= 100) / avg(CAST(y AS DOUBLE)) AS lift_100}} FROM k GROUP BY industry", "panel")
def ev15_average_precision(spark, sf_dir):
    """Area under precision and recall as average precision, and the lift of the first hundred."""
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("y", (F.col("r_20") > 1).cast("int"))
    w = Window.partitionBy("industry").orderBy(F.desc("bias"), "symbol", "trade_date")
    d = d.withColumns({"k": F.row_number().over(w), "tp": F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return d.groupBy("industry").agg((F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("k"))) / F.sum("y")).alias("average_precision"), F.avg("y").alias("base"), (F.avg(F.when(F.col("k") <= 100, F.col("y"))) / F.avg("y")).alias("lift_100"))


@query(f"{FACTS} SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, cap, industry, {STATS} FROM facts WHERE surge > 1.2 GROUP BY GROUPING SETS ((date_trunc('month', trade_date)), (cap), (industry))", "panel")
def ev10_stability_sets(spark, sf_dir):
    d = facts(spark, sf_dir).where("surge > 1.2").withColumn("month", F.to_date(F.date_trunc("month", "trade_date")))
    return d.groupingSets([[F.col(c)] for c in ("month", "cap", "industry")], "month", "cap", "industry").agg(*P.outcome())


@query(f"{FACTS} SELECT cap, value, industry, count(bias + r_20) AS n, {{corr(bias, r_20) AS ic}} FROM facts GROUP BY GROUPING SETS ((cap), (value), (industry)) HAVING count(bias + r_20) >= 50", "panel")
def ev02_layers(spark, sf_dir):
    d = facts(spark, sf_dir)
    return d.groupingSets([[F.col(c)] for c in ("cap", "value", "industry")], "cap", "value", "industry").agg(F.count(F.col("bias") + F.col("r_20")).alias("n"), P.correlation("bias", "r_20").alias("ic")).where("n >= 50")


_BOOKS = ("bias", "place", "surge")


@query(f"{FACTS}, wk AS (SELECT max(trade_date) AS trade_date FROM bars GROUP BY date_trunc('month', trade_date)), l AS ({' UNION ALL '.join(f'SELECT {chr(39)}{b}{chr(39)} AS version, trade_date, {b} AS x, r_5 FROM facts' for b in _BOOKS)} UNION ALL SELECT 'mean', trade_date, (bias + place + surge) / 3, r_5 FROM facts), o AS (SELECT l.* FROM l JOIN wk USING (trade_date) WHERE r_5 IS NOT NULL AND x IS NOT NULL), q AS (SELECT version, trade_date, round(quantile_cont(x, 0.8), 9) AS hi, round(quantile_cont(x, 0.2), 9) AS lo FROM o GROUP BY ALL) SELECT version, trade_date, {{avg(CASE WHEN round(x, 9) >= hi THEN r_5 END) AS long}}, {{avg(CASE WHEN round(x, 9) <= lo THEN r_5 END) AS short}}, {{avg(CASE WHEN round(x, 9) >= hi THEN r_5 END) - avg(CASE WHEN round(x, 9) <= lo THEN r_5 END) AS spread}} FROM o JOIN q USING (version, trade_date) GROUP BY ALL", "panel")
def pb01_four_versions(spark, sf_dir):
    """Long and short fifths of four scores on each month's last date."""
    d = facts(spark, sf_dir).where("r_5 IS NOT NULL")
    last = t(spark, sf_dir, "bars").groupBy(F.date_trunc("month", "trade_date")).agg(F.max("trade_date").alias("trade_date")).select("trade_date")
    scores = F.array(*(F.struct(F.lit(b).alias("version"), F.col(b).alias("x")) for b in _BOOKS), F.struct(F.lit("mean").alias("version"), ((F.col("bias") + F.col("place") + F.col("surge")) / 3).alias("x")))
    long = d.join(last, "trade_date", "left_semi").select("trade_date", "r_5", F.explode(scores).alias("s")).select("trade_date", "r_5", "s.version", "s.x").where("x IS NOT NULL")
    q = long.groupBy("version", "trade_date").agg(F.expr("percentile(x, array(0.2D, 0.8D))").alias("q"))
    x = F.round("x", 9)
    up, down = F.avg(F.when(x >= F.round(F.get("q", 1), 9), F.col("r_5"))), F.avg(F.when(x <= F.round(F.get("q", 0), 9), F.col("r_5")))
    return long.join(q, ["version", "trade_date"]).groupBy("version", "trade_date").agg(up.alias("long"), down.alias("short"), (up - down).alias("spread"))
