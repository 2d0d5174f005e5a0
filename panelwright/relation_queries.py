"""Registered queries of projections, joins, aggregations, selections, sets and scalar families; the SQL beside each is written by itself."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .operators import panels as P
from .panel_queries import FACTS, STATS, W_, facts, lab, query, t
from .sources.fixtures import CTES, read

#: CTEs of a second source after the first one's.
SIGNALS, HOLDINGS, FLOW = (CTES[s] for s in ("signals", "holdings", "flow"))
_SIGNALS = SIGNALS.split(",\nsignals AS ")[1]
_FLOW, _HELD = FLOW.split(",\nflow AS ")[1], HOLDINGS.split(",\nholdings AS ")[1]
THREE = ("bias", "place", "surge")


# Projections ---------------------------------------------------------------------------------------------


@query(f"signals AS {_SIGNALS}, l AS (SELECT symbol, arg_max(total_mv, trade_date) AS cap FROM panel GROUP BY symbol), u AS (SELECT * FROM l WHERE NOT regexp_matches(symbol, '5$') AND cap >= 50.0 AND symbol IN (SELECT symbol FROM signals WHERE score > 50)) SELECT symbol, {{cap AS cap}}, CAST((row_number() OVER (ORDER BY symbol) - 1) // 10 + 1 AS INTEGER) AS group_id FROM u", "panel")
def pr01_universe(spark, sf_dir):
    """Symbols not excluded by pattern, above the cap floor and in the signals; group ids of ten, stable under reruns."""
    latest = t(spark, sf_dir, "panel").groupBy("symbol").agg(F.max_by("total_mv", "trade_date").alias("cap"))
    some = t(spark, sf_dir, "signals").where("score > 50").select("symbol")
    d = latest.where(~F.col("symbol").rlike("5$") & (F.col("cap") >= 50)).join(some, "symbol", "left_semi")
    # One row per symbol.
    return d.withColumn("group_id", F.floor((F.row_number().over(Window.orderBy("symbol")) - 1) / 10 + 1).cast("int"))


def numeric_columns(d: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in d.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


_NUM = ("open", "high", "low", "close", "vol", "amount", "pe")


@query(" UNION ALL ".join(f"SELECT '{c}' AS factor, count({c}) AS n, {{avg({c}) AS mean}} FROM panel" for c in _NUM), "panel")
def pr02_numeric_projection(spark, sf_dir):
    d = t(spark, sf_dir, "panel")
    names = numeric_columns(d, exclude=("total_mv",))
    long = d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in names))).alias("c")).select("c.*")
    return long.groupBy("factor").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


@query(f"{FACTS} SELECT symbol, trade_date, {{r_20 AS r_20}} FROM facts WHERE abs(r_20) <= 4", "panel")
def pr04_extremes_excluded(spark, sf_dir):
    return facts(spark, sf_dir).where("abs(r_20) <= 4").select("symbol", "trade_date", "r_20")


@query("SELECT symbol, trade_date, {CASE WHEN high = low THEN -1.0 ELSE vol / (high - low) END AS per_range}, {coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1, 0.0) AS pct} FROM bars")
def pr06_infinite_to_null(spark, sf_dir):
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    b = t(spark, sf_dir, "bars").withColumns({"per_range": F.when(F.col("high") == F.col("low"), float("inf")).otherwise(F.try_divide("vol", F.col("high") - F.col("low"))), "pct": F.try_divide("close", F.lag("close").over(P.by_time())) - 1})
    return b.select("symbol", "trade_date", F.coalesce(finite(F.col("per_range")), F.lit(-1.0)).alias("per_range"), F.coalesce(finite(F.col("pct")), F.lit(0.0)).alias("pct"))


@query(f"holdings AS {_HELD}, {FACTS}, h AS (SELECT DISTINCT symbol FROM holdings WHERE k = 1) SELECT symbol, trade_date FROM facts WHERE NOT coalesce(industry IN ('I0', 'I1') AND cap <= 1 AND symbol NOT IN (SELECT symbol FROM h), false)", "panel")
def pr07_blacklist(spark, sf_dir):
    held = t(spark, sf_dir, "holdings").where("k = 1").select("symbol").distinct().withColumn("held", F.lit(True))
    d = facts(spark, sf_dir).join(held, "symbol", "left")
    bad = F.col("industry").isin("I0", "I1") & (F.col("cap") <= 1) & F.col("held").isNull()
    return d.where(~F.coalesce(bad, F.lit(False))).select("symbol", "trade_date")


@query("c AS (SELECT DISTINCT p_brand AS symbol, split_part(p_brand, '#', 2) AS code FROM part) SELECT symbol, code, CASE WHEN code[1] IN ('2', '3') THEN 'SZ' WHEN code[1] = '1' THEN 'SH' ELSE 'BJ' END AS market, lpad(code, 6, '0') || '.' || CASE WHEN code[1] IN ('2', '3') THEN 'SZ' WHEN code[1] = '1' THEN 'SH' ELSE 'BJ' END AS ts_code FROM c")
def pr10_market_of_code(spark, sf_dir):
    c = read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("code", F.get(F.split("symbol", "#"), 1))
    market = F.when(F.col("code").startswith("2") | F.col("code").startswith("3"), "SZ").when(F.col("code").startswith("1"), "SH").otherwise("BJ")
    return c.select("symbol", "code", market.alias("market"), F.concat(F.lpad("code", 6, "0"), F.lit("."), market).alias("ts_code"))


# Joins ---------------------------------------------------------------------------------------------------


@query(f"flow AS {_FLOW}, {lab('bars')} SELECT f.symbol, f.trade_date, {{buy_elg_amount + buy_lg_amount - sell_elg_amount - sell_lg_amount AS main}}, {{r_20 AS r_20}} FROM flow f LEFT JOIN (SELECT * FROM lab WHERE vol >= 120) l ON f.symbol = l.symbol AND f.trade_date = l.trade_date")
def jn01_features_and_labels(spark, sf_dir):
    labels = P.forward(t(spark, sf_dir, "bars"), (20,)).where("vol >= 120").select("symbol", "trade_date", "r_20")
    f = t(spark, sf_dir, "flow").withColumn("main", F.expr("buy_elg_amount + buy_lg_amount - sell_elg_amount - sell_lg_amount"))
    return f.select("symbol", "trade_date", "main").join(labels, ["symbol", "trade_date"], "left")


def slice_at(group: DataFrame, at: Column, values: list[str], key: str = P.SYMBOL, date: str = P.DATE) -> DataFrame:
    """Of each key the row of the date, or the latest one before it: (key, values, <first value>_date)."""
    rows = group.where(F.col(date) <= at)
    best = F.max_by(F.struct(*values, F.col(date).alias("__date")), date)
    return rows.groupBy(key).agg(best.alias("x")).select(key, *(F.col("x")[v].alias(v) for v in values), F.col("x")["__date"].alias(f"{values[0]}_date"))


_SLICE = lambda g, v: f"(SELECT symbol, arg_max({v}, trade_date) AS {v}, max(trade_date) AS {v}_date FROM {g} WHERE trade_date <= DATE '1998-06-01' GROUP BY symbol)"


@query(f"flow AS {_FLOW}, thin AS (SELECT * FROM flow WHERE buy_elg_amount > 40000), s AS ({SIGNALS.split('signals AS (')[1][:-1]}), d AS (SELECT symbol, trade_date, avg(score) AS score FROM s GROUP BY ALL), x AS (SELECT DISTINCT symbol FROM bars) SELECT symbol, {{close AS close}}, close_date, {{buy_elg_amount AS buy_elg_amount}}, buy_elg_amount_date, {{total_mv AS total_mv}}, total_mv_date, {{pe AS pe}}, pe_date, {{score AS score}}, score_date, {{vol AS vol}}, vol_date FROM x LEFT JOIN {_SLICE('bars', 'close')} USING (symbol) LEFT JOIN {_SLICE('thin', 'buy_elg_amount')} USING (symbol) LEFT JOIN {_SLICE('dims', 'total_mv')} USING (symbol) LEFT JOIN {_SLICE('(SELECT * FROM dims WHERE pe > 100)', 'pe')} USING (symbol) LEFT JOIN {_SLICE('d', 'score')} USING (symbol) LEFT JOIN {_SLICE('(SELECT * FROM bars WHERE vol > 300)', 'vol')} USING (symbol)", "dims")
def jn03_six_groups_of_a_date(spark, sf_dir):
    """Six feature groups of one date; where a symbol lacks the date, its latest row before it."""
    bars, dims = t(spark, sf_dir, "bars"), t(spark, sf_dir, "dims")
    scores = t(spark, sf_dir, "signals").groupBy("symbol", "trade_date").agg(F.avg("score").alias("score"))
    groups = [(bars, "close"), (t(spark, sf_dir, "flow").where("buy_elg_amount > 40000"), "buy_elg_amount"), (dims, "total_mv"), (dims.where("pe > 100"), "pe"), (scores, "score"), (bars.where("vol > 300"), "vol")]
    at = F.lit("1998-06-01").cast("date")
    return reduce(lambda d, g: d.join(slice_at(g[0], at, [g[1]]), "symbol", "left"), groups, bars.select("symbol").distinct())


NAMES = {"I0": "banks", "I1": "chips", "I2": "energy", "I3": "retail"}


@query(f"holdings AS {_HELD} SELECT symbol, trade_date, CASE industry {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in NAMES.items())} ELSE 'other' END AS name, symbol IN (SELECT symbol FROM holdings WHERE k <= 2) AS held FROM panel", "panel")
def jn04_attributes(spark, sf_dir):
    """Names from a dictionary with a default, and whether a symbol is among the holdings' first two."""
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    held = t(spark, sf_dir, "holdings").where("k <= 2").select("symbol").distinct().withColumn("is_held", F.lit(True))
    d = t(spark, sf_dir, "panel").join(held, "symbol", "left")
    return d.select("symbol", "trade_date", F.coalesce(F.try_element_at(names, F.col("industry")), F.lit("other")).alias("name"), F.coalesce("is_held", F.lit(False)).alias("held"))


@query("m AS (SELECT trade_date, avg(close) AS peer FROM bars GROUP BY trade_date HAVING count(*) >= 10), j AS (SELECT b.symbol, b.trade_date, close, peer, row_number() OVER (PARTITION BY symbol ORDER BY b.trade_date DESC) AS k FROM bars b JOIN m USING (trade_date)) SELECT symbol, trade_date, CAST(k AS INTEGER) AS k, {close AS close}, {peer AS peer} FROM j WHERE k <= 60")
def jn09_aligned_series(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    m = b.groupBy("trade_date").agg(F.avg("close").alias("peer"), F.count(F.lit(1)).alias("n")).where("n >= 10").drop("n")
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    return b.join(m, "trade_date").withColumn("k", k).where("k <= 60").select("symbol", "trade_date", "k", "close", "peer")


PIVOTS = f"n AS (SELECT *, CAST(row_number() OVER ({W_}) AS INTEGER) AS i, max(high) OVER ({W_} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS h7 FROM bars), pv AS (SELECT symbol, i, high FROM n WHERE high = h7)"


def pivots(bars: DataFrame, side: str = "high", k: int = 3) -> DataFrame:
    """(symbol, i, <side>) of bars whose high (low) is the extreme of the k rows on both sides; i numbers a symbol's bars."""
    w = P.by_time()
    best = (F.max if side == "high" else F.min)(side).over(w.rowsBetween(-k, k))
    return bars.withColumns({"i": F.row_number().over(w), "best": best}).where(F.col(side) == F.col("best")).select("symbol", "i", side)


def pivot_pairs(points: DataFrame, value: str, nearest: int, farthest: int) -> DataFrame:
    """Pairs i < j of a symbol's pivots, `nearest` to `farthest` rows apart: an equi-join on blocks of `farthest` rows, never all pairs of a symbol."""
    a = points.select("symbol", "i", F.col(value).alias("a")).withColumn("block", F.explode(F.array(F.floor(F.col("i") / farthest), F.floor(F.col("i") / farthest) + 1)))
    b = points.select("symbol", F.col("i").alias("j"), F.col(value).alias("b"), F.floor(F.col("i") / farthest).alias("block"))
    return a.join(b, ["symbol", "block"]).where((F.col("j") - F.col("i")).between(nearest, farthest)).drop("block")


@query(f"{PIVOTS}, p AS (SELECT a.symbol, a.i, b.i AS j, a.high AS a, (b.high - a.high) / (b.i - a.i) AS slope FROM pv a JOIN pv b ON a.symbol = b.symbol AND b.i - a.i BETWEEN 8 AND 40) SELECT symbol, i, j, {{slope AS slope}} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY j - i DESC, abs(round(slope, 9)), i) AS k FROM p) WHERE k <= 3")
def jn10_pivot_pairs(spark, sf_dir):
    p = pivot_pairs(pivots(t(spark, sf_dir, "bars")), "high", 8, 40).withColumn("slope", (F.col("b") - F.col("a")) / (F.col("j") - F.col("i")))
    order = Window.partitionBy("symbol").orderBy((F.col("j") - F.col("i")).desc(), F.abs(F.round("slope", 9)), "i")
    return p.withColumn("k", F.row_number().over(order)).where("k <= 3").select("symbol", "i", "j", "slope")


@query(f"{FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY surge DESC NULLS LAST, symbol) AS rk FROM facts WHERE r_20 IS NOT NULL), s AS (SELECT trade_date, avg(r_20) AS s FROM k WHERE rk <= 5 GROUP BY trade_date), m AS (SELECT trade_date, avg(r_20) AS m FROM facts WHERE r_20 IS NOT NULL GROUP BY trade_date) SELECT trade_date, {{s AS strategy}}, {{m AS market}}, {{s - m AS excess}}, s > m AS wins FROM s JOIN m USING (trade_date)", "panel")
def jn11_strategy_and_benchmark(spark, sf_dir):
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL")
    top = P.top_n(d, ["trade_date"], "surge", 5).groupBy("trade_date").agg(F.avg("r_20").alias("strategy"))
    m = d.groupBy("trade_date").agg(F.avg("r_20").alias("market"))
    return top.join(m, "trade_date").withColumns({"excess": F.col("strategy") - F.col("market"), "wins": F.col("strategy") > F.col("market")})


@query("c AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS concept FROM part), n AS (SELECT DISTINCT p_name AS board FROM part) SELECT board, concept FROM n JOIN c ON contains(board, concept) OR contains(concept, board)")
def jn12_substring_join(spark, sf_dir):
    """Boards whose name holds a concept's or the other way round; names are distinct words of the parts' vocabulary, a few dozen."""
    p = read(spark, sf_dir, "part")
    concepts = p.select(F.get(F.split("p_name", " "), 1).alias("concept")).distinct()
    boards = p.select(F.col("p_name").alias("board")).distinct()
    return boards.join(concepts, F.col("board").contains(F.col("concept")) | F.col("concept").contains(F.col("board")))


# Aggregations --------------------------------------------------------------------------------------------


@query("n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) - 1) // 5 AS block FROM bars) SELECT symbol, CAST(block AS INTEGER) AS block, min(trade_date) AS first, {arg_min(open, trade_date) AS open}, {max(high) AS high}, {min(low) AS low}, {arg_max(close, trade_date) AS close}, {sum(vol) AS vol}, count(*) AS n FROM n GROUP BY symbol, block")
def ag02_position_blocks(spark, sf_dir):
    """Bars of five rows each, counted from a symbol's last row."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    d = t(spark, sf_dir, "bars").withColumn("block", F.floor((back - 1) / 5).cast("int"))
    return d.groupBy("symbol", "block").agg(F.min("trade_date").alias("first"), F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.sum("vol").alias("vol"), F.count(F.lit(1)).alias("n"))


@query(f"{FACTS}, l AS (SELECT 'cap' AS factor, cap AS bucket, r_20 FROM facts UNION ALL SELECT 'value', value, r_20 FROM facts), g AS (SELECT factor, bucket, count(*) AS rows, {STATS.replace('{', '').replace('}', '')} FROM l GROUP BY factor, bucket) SELECT factor, bucket, rows, {{rows / sum(rows) OVER (PARTITION BY factor) AS share}}, n, {{win_rate AS win_rate}}, {{mean AS mean}}, {{median AS median}} FROM g", "panel")
def ag04_bucket_profile(spark, sf_dir):
    d = facts(spark, sf_dir).select("r_20", F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).alias("bucket")) for c in ("cap", "value")))).alias("x")).select("x.*", "r_20")
    g = d.groupBy("factor", "bucket").agg(F.count(F.lit(1)).alias("rows"), *P.outcome())
    return g.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("factor")))


@query("h AS (SELECT fund, substring(symbol, 7, 1) AS theme, count(*) AS n, sum(weight) AS w FROM holdings GROUP BY ALL) SELECT fund, string_agg(theme || '=' || CAST(n AS VARCHAR), ',' ORDER BY theme) AS histogram, arg_max(theme, row(n, w, theme)) AS top_theme, {avg(nullif(w, 0)) AS mean_weight} FROM h GROUP BY fund", "holdings")
def ag12_theme_histogram(spark, sf_dir):
    """Per fund a map theme -> count, read back as text; its top theme and the mean of its themes' weights."""
    h = t(spark, sf_dir, "holdings").groupBy("fund", F.substring("symbol", 7, 1).alias("theme")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    g = h.groupBy("fund").agg(F.map_from_entries(F.collect_list(F.struct("theme", "n"))).alias("map"), F.max_by("theme", F.struct("n", "w", "theme")).alias("top_theme"), F.avg(F.nullif("w", F.lit(0.0))).alias("mean_weight"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("map")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return g.select("fund", shown.alias("histogram"), "top_theme", "mean_weight")


@query("x AS (SELECT symbol, 'P' || CAST(o_orderkey % 3 AS VARCHAR) AS provider, 'A' || CAST(o_orderkey % 5 AS VARCHAR) AS agent, avg(score) AS score FROM signals GROUP BY ALL) SELECT symbol, agent, count(*) AS providers, {avg(score) AS mean} FROM x GROUP BY symbol, agent", "signals")
def ag13_nested_scores(spark, sf_dir):
    """Scores in a map provider -> (agent -> score) per symbol, exploded twice and averaged by agent."""
    s = t(spark, sf_dir, "signals").withColumns({"provider": F.concat(F.lit("P"), (F.col("o_orderkey") % 3).cast("string")), "agent": F.concat(F.lit("A"), (F.col("o_orderkey") % 5).cast("string"))})
    inner = s.groupBy("symbol", "provider", "agent").agg(F.avg("score").alias("score")).groupBy("symbol", "provider").agg(F.map_from_entries(F.collect_list(F.struct("agent", "score"))).alias("agents"))
    nested = inner.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("provider", "agents"))).alias("providers"))
    flat = nested.select("symbol", F.explode("providers").alias("provider", "agents")).select("symbol", "provider", F.explode("agents").alias("agent", "score"))
    return flat.groupBy("symbol", "agent").agg(F.count("score").alias("providers"), F.avg("score").alias("mean"))


_STATE = "CASE WHEN close > open * 1.002 THEN 'up' WHEN close < open * 0.998 THEN 'down' ELSE 'flat' END"


@query(f"s AS (SELECT symbol, trade_date, {_STATE} AS s FROM bars), l AS (SELECT *, lag(s) OVER ({W_}) AS s1, lag(s, 2) OVER ({W_}) AS s2 FROM s) SELECT symbol, trade_date, s AS state, CASE WHEN s1 = s2 THEN s1 ELSE s END AS dominant FROM l")
def ag15_dominant_state(spark, sf_dir):
    """The most frequent state of the last three rows; three different ones, or fewer rows: the latest."""
    w = P.by_time()
    d = t(spark, sf_dir, "bars").withColumn("state", F.when(F.col("close") > F.col("open") * 1.002, "up").when(F.col("close") < F.col("open") * 0.998, "down").otherwise("flat"))
    last3 = F.collect_list("state").over(w.rowsBetween(-2, 0))
    top = F.get(F.filter(last3, lambda x: F.size(F.filter(last3, lambda y: y == x)) >= 2), 0)
    return d.select("symbol", "trade_date", "state", F.coalesce(top, F.col("state")).alias("dominant"))


@query("p AS (SELECT l_suppkey AS fund, date_trunc('quarter', trade_date) AS period, symbol, sum(l_extendedprice) AS w FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_suppkey, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL), x AS (SELECT *, max(period) OVER (PARTITION BY fund) AS latest FROM p), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY fund ORDER BY w DESC, symbol) AS INTEGER) AS k FROM x WHERE period = latest) SELECT fund, CAST(period AS DATE) AS period, symbol, {w AS weight}, k FROM k WHERE k <= 10")
def ag17_latest_holdings(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol")), F.col("l_partkey") == F.col("p_partkey"))
    p = lines.groupBy(F.col("l_suppkey").alias("fund"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period"), "symbol").agg(F.sum("l_extendedprice").alias("weight"))
    p = p.withColumn("latest", F.max("period").over(Window.partitionBy("fund"))).where("period = latest")
    k = F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("weight"), "symbol"))
    return p.withColumn("k", k).where("k <= 10").select("fund", "period", "symbol", "weight", "k")


_Z = ", ".join(f"(({f}) - avg({f}) OVER (PARTITION BY trade_date)) AS z_{f}" for f in THREE)


@query(f"{FACTS}, z AS (SELECT r_20, {_Z} FROM facts WHERE {' AND '.join(f'{f} IS NOT NULL' for f in THREE)} AND r_20 IS NOT NULL) SELECT {{corr((z_bias + z_place + z_surge) / 3, r_20) AS all_three}}, {', '.join('{' + f'corr((z_bias + z_place + z_surge - z_{f}) / 2, r_20) AS without_{f}' + '}' for f in THREE)} FROM z", "panel")
def ag20_leave_one_out(spark, sf_dir):
    d = facts(spark, sf_dir).dropna(subset=[*THREE, "r_20"])
    d = d.select("r_20", *((F.col(f) - F.avg(f).over(Window.partitionBy("trade_date"))).alias(f) for f in THREE))
    total = F.col("bias") + F.col("place") + F.col("surge")
    return d.agg(P.correlation(total / 3, "r_20").alias("all_three"), *(P.correlation((total - F.col(f)) / 2, "r_20").alias(f"without_{f}") for f in THREE))


# Ranks and selections --------------------------------------------------------------------------------------


@query(f"{FACTS}, e AS (SELECT industry, {', '.join(f'quantile_cont(cap, {k / 10}) AS e{k}' for k in range(1, 10))}, min(cap) AS lo, max(cap) AS hi FROM facts GROUP BY industry), g AS (SELECT *, list_unique([{', '.join(f'e{k}' for k in range(1, 10))}]) AS u FROM e) SELECT symbol, trade_date, CASE WHEN u = 9 THEN {' + '.join(f'CAST(e{k} < cap AS INTEGER)' for k in range(1, 10))} + 1 ELSE CAST(least(9, floor((cap - lo) * 10 / nullif(hi - lo, 0))) AS INTEGER) + 1 END AS decile, u < 9 AS equal_width FROM facts JOIN g USING (industry)", "panel")
def rk03_deciles(spark, sf_dir):
    """Deciles by quantile edges; where edges coincide, ten equal parts of the range instead. Here of the cap bucket, whose edges do coincide."""
    d = facts(spark, sf_dir)
    e = d.groupBy("industry").agg(F.expr(f"percentile(cap, array({', '.join(f'{k / 10}D' for k in range(1, 10))}))").alias("edges"), F.min("cap").alias("lo"), F.max("cap").alias("hi"))
    d = d.join(e, "industry").withColumn("equal_width", F.size(F.array_distinct("edges")) < 9)
    wide = F.least(F.lit(9), F.floor((F.col("cap") - F.col("lo")) * 10 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))))
    return d.select("symbol", "trade_date", F.when(F.col("equal_width"), wide.cast("int") + 1).otherwise(F.size(F.filter("edges", lambda x: x < F.col("cap"))) + 1).cast("int").alias("decile"), "equal_width")


@query(f"{FACTS}, o AS (SELECT *, row_number() OVER (ORDER BY surge DESC, symbol, trade_date) AS k, count(*) OVER () AS n FROM facts WHERE surge IS NOT NULL) SELECT symbol, trade_date, {{surge AS surge}}, CASE WHEN k <= floor(n * 0.01) THEN 'top' ELSE 'bottom' END AS side FROM o WHERE k <= floor(n * 0.01) OR k > n - floor(n * 0.05)", "panel")
def rk06_ends_of_all(spark, sf_dir):
    """The first 1 % and the last 5 % of all rows by `surge`: two limited sorts, which run in ranges, no window over everything."""
    d = facts(spark, sf_dir).where("surge IS NOT NULL").select("symbol", "trade_date", "surge")
    n = d.count()
    order = lambda desc: [F.col("surge").desc() if desc else F.col("surge").asc(), *(F.col(c).asc() if desc else F.col(c).desc() for c in ("symbol", "trade_date"))]
    top = d.orderBy(*order(True)).limit(int(n * 0.01)).withColumn("side", F.lit("top"))
    return top.union(d.orderBy(*order(False)).limit(int(n * 0.05)).withColumn("side", F.lit("bottom")))


@query(f"{FACTS}, c AS (SELECT trade_date, symbol, surge, CASE WHEN surge > 1.8 THEN 0 WHEN surge > 1.3 THEN 1 ELSE 2 END AS p FROM facts) SELECT trade_date, symbol, CASE p WHEN 0 THEN 'severe' WHEN 1 THEN 'warning' ELSE 'normal' END AS class, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY p, abs(surge - 1) DESC NULLS LAST, symbol) AS INTEGER) AS place FROM c", "panel")
def rk12_priority_sort(spark, sf_dir):
    kind = F.when(F.col("surge") > 1.8, "severe").when(F.col("surge") > 1.3, "warning").otherwise("normal")
    d = facts(spark, sf_dir).withColumn("class", kind)
    order = F.when(F.col("class") == "severe", 0).when(F.col("class") == "warning", 1).otherwise(2)
    w = Window.partitionBy("trade_date").orderBy(order, F.abs(F.col("surge") - 1).desc_nulls_last(), "symbol")
    return d.select("trade_date", "symbol", "class", F.row_number().over(w).alias("place"))


@query(f"{FACTS}, b AS (SELECT symbol, trade_date, r_20 >= 5 AS y, md5(symbol || '|' || CAST(trade_date AS VARCHAR) || '|42') AS h FROM facts WHERE r_20 IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY y, substring(h, 1, 1) ORDER BY h) AS r, count(CASE WHEN y THEN 1 END) OVER () AS p FROM b) SELECT symbol, trade_date, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) AS g FROM k) WHERE y OR g <= 5 * p", "panel")
def rk13_seeded_sample(spark, sf_dir):
    """All positives and five negatives for each, those of least seeded hash: the same rows on every run."""
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").select("symbol", "trade_date", (F.col("r_20") >= 5).alias("y"), F.md5(F.concat_ws("|", "symbol", F.col("trade_date").cast("string"), F.lit("42"))).alias("h"))
    n = d.where("y").count()
    return d.where("y").union(d.where("NOT y").orderBy("h").limit(5 * n)).drop("h")


@query(f"{FACTS}, p AS (SELECT *, CASE WHEN cap <= 1 THEN 'small' WHEN surge > 1.3 THEN 'active' ELSE 'core' END AS pool FROM facts WHERE trade_date = DATE '1997-03-03') SELECT pool, symbol, {{bias AS bias}}, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pool ORDER BY bias DESC NULLS LAST, symbol) AS INTEGER) AS k FROM p) WHERE k <= 4", "panel")
def rk14_top_by_pool(spark, sf_dir):
    d = facts(spark, sf_dir).where("trade_date = DATE '1997-03-03'")
    d = d.withColumn("pool", F.when(F.col("cap") <= 1, "small").when(F.col("surge") > 1.3, "active").otherwise("core"))
    return P.top_n(d, ["pool"], "bias", 4).select("pool", "symbol", "bias", F.col("rank").alias("k"))


@query(f"{FACTS}, a AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY surge DESC NULLS LAST, symbol) AS k FROM facts), b AS (SELECT *, 0.5 * place + 0.5 * bias AS again FROM a WHERE k <= 10) SELECT trade_date, symbol, {{again AS score}}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY round(again, 9) DESC NULLS LAST, symbol) AS INTEGER) AS rank FROM b) WHERE rank <= 3", "panel")
def rk15_retrieve_and_rerank(spark, sf_dir):
    first = P.top_n(facts(spark, sf_dir), ["trade_date"], "surge", 10).drop("rank").withColumn("score", 0.5 * F.col("place") + 0.5 * F.col("bias"))
    w = Window.partitionBy("trade_date").orderBy(F.round("score", 9).desc_nulls_last(), "symbol")
    return first.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("trade_date", "symbol", "score", "rank")


# Sets ------------------------------------------------------------------------------------------------------


@query("SELECT symbol, trade_date, {close AS close}, CAST(NULL AS DOUBLE) AS vol FROM bars WHERE close > 103 UNION ALL SELECT symbol, trade_date, CAST(NULL AS DOUBLE), {vol AS vol} FROM bars WHERE vol > 250")
def st01_union_of_parts(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    return b.where("close > 103").select("symbol", "trade_date", "close").unionByName(b.where("vol > 250").select("symbol", "trade_date", "vol"), allowMissingColumns=True)


@query(f"{SIGNALS} SELECT DISTINCT symbol, trade_date FROM (SELECT symbol, trade_date FROM bars WHERE vol > 200 UNION ALL SELECT symbol, trade_date FROM signals WHERE score > 80)")
def st02_distinct_keys(spark, sf_dir):
    keys = ["symbol", "trade_date"]
    return t(spark, sf_dir, "bars").where("vol > 200").select(keys).union(t(spark, sf_dir, "signals").where("score > 80").select(keys)).distinct()


@query(f"{SIGNALS} SELECT symbol, trade_date, symbol || '|' || strftime(trade_date, '%Y%m%d') IN (SELECT symbol || '|' || strftime(trade_date, '%Y%m%d') FROM signals WHERE score > 60) AS known FROM bars")
def st05_composite_key(spark, sf_dir):
    key = F.concat_ws("|", "symbol", F.date_format("trade_date", "yyyyMMdd"))
    known = t(spark, sf_dir, "signals").where("score > 60").select(key.alias("key")).distinct().withColumn("known", F.lit(True))
    return t(spark, sf_dir, "bars").withColumn("key", key).join(known, "key", "left").select("symbol", "trade_date", F.coalesce("known", F.lit(False)).alias("known"))


# Scalar families -------------------------------------------------------------------------------------------


@query("SELECT c_custkey, {abs(c_acctbal) AS a}, {sign(c_acctbal) AS s}, {ln(1 + abs(c_acctbal)) AS l1}, {log10(abs(c_acctbal) + 1e-12) AS l10}, {sqrt(abs(c_acctbal)) AS root}, {power(abs(c_acctbal) / 1000, 1.5) AS p}, {round(c_acctbal / 7, 2) AS r}, {least(greatest(c_acctbal, 0), 5000) AS clipped}, {c_acctbal / (abs(c_acctbal) + 1e-3) AS guarded} FROM customer")
def sc01_math(spark, sf_dir):
    x = F.col("c_acctbal")
    out = {"a": F.abs(x), "s": F.signum(x), "l1": F.log1p(F.abs(x)), "l10": F.log10(F.abs(x) + 1e-12), "root": F.sqrt(F.abs(x)), "p": F.pow(F.abs(x) / 1000, 1.5), "r": F.round(x / 7, 2), "clipped": F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)), "guarded": F.try_divide(x, F.abs(x) + 1e-3)}
    return read(spark, sf_dir, "customer").select("c_custkey", *(e.alias(c) for c, e in out.items()))


def anchored(x: Column, p5: Column, p50: Column, p95: Column) -> Column:
    """0 to 100: p5 and below 0, p50 at 50, p95 and above 100, straight lines between."""
    low = 50 * (x - p5) / F.nullif(p50 - p5, F.lit(0.0))
    high = 50 + 50 * (x - p50) / F.nullif(p95 - p50, F.lit(0.0))
    return F.when(x.isNull(), 50.0).when(x <= p5, 0.0).when(x >= p95, 100.0).when(x <= p50, low).otherwise(high)


@query("q AS (SELECT symbol, quantile_cont(vol, 0.05) AS a, quantile_cont(vol, 0.5) AS b, quantile_cont(vol, 0.95) AS c FROM bars GROUP BY symbol) SELECT symbol, trade_date, {CASE WHEN vol <= a THEN 0.0 WHEN vol >= c THEN 100.0 WHEN vol <= b THEN 50 * (vol - a) / (b - a) ELSE 50 + 50 * (vol - b) / (c - b) END AS mapped} FROM bars JOIN q USING (symbol)")
def sc02_anchored_map(spark, sf_dir):
    b = t(spark, sf_dir, "bars")
    q = b.groupBy("symbol").agg(F.expr("percentile(vol, array(0.05D, 0.5D, 0.95D))").alias("q"))
    return b.join(q, "symbol").select("symbol", "trade_date", anchored(F.col("vol"), *(F.get("q", k) for k in range(3))).alias("mapped"))


@query(f"{FACTS}, g AS (SELECT industry, exp(avg(CASE WHEN pe > 0 THEN ln(pe) END)) AS geo, count(r_20) AS n, avg(r_20) AS m, (SELECT avg(r_20) FROM facts) AS prior FROM facts GROUP BY industry) SELECT industry, {{geo AS geometric}}, {{(n * m + 200 * prior) / (n + 200) AS shrunk}} FROM g", "panel")
def sc03_means(spark, sf_dir):
    """Geometric mean of what is above 0, and a mean shrunk towards the whole's by 200 pseudo-rows."""
    d = facts(spark, sf_dir)
    g = d.groupBy("industry").agg(F.exp(F.avg(F.when(F.col("pe") > 0, F.log("pe")))).alias("geometric"), F.count("r_20").alias("n"), F.avg("r_20").alias("m"))
    g = g.join(F.broadcast(d.agg(F.avg("r_20").alias("prior"))))  # one row
    return g.select("industry", "geometric", ((F.col("n") * F.col("m") + 200 * F.col("prior")) / (F.col("n") + 200)).alias("shrunk"))


@query("d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS s, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, s, CAST(strptime(s, '%Y%m%d') AS DATE) AS parsed, CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(week(d) AS INTEGER) AS iso_week, CAST(date_trunc('month', d) AS DATE) AS month, CAST(date_trunc('week', d) + INTERVAL 4 DAY AS DATE) AS friday, CAST(round((DATE '2000-01-01' - d) / 1.4 - 0.0001) AS INTEGER) AS trading_days, CAST((2000 - year(d)) * 12 + 1 - month(d) AS INTEGER) AS months FROM d")
def sc04_dates(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("s"), F.to_date("o_orderdate").alias("d"))
    end = F.lit("2000-01-01").cast("date")
    return d.select(
        "o_orderkey", "s", F.to_date("s", "yyyyMMdd").alias("parsed"), F.expr("CAST(extract(YEAROFWEEK FROM d) AS INT)").alias("iso_year"), F.weekofyear("d").alias("iso_week"), F.to_date(F.date_trunc("month", "d")).alias("month"),
        F.date_add(F.to_date(F.date_trunc("week", "d")), 4).alias("friday"), F.round(F.datediff(end, "d") / 1.4 - 0.0001).cast("int").alias("trading_days"), ((2000 - F.year("d")) * 12 + 1 - F.month("d")).cast("int").alias("months"),
    )


@query(f"c AS (SELECT symbol, trade_date, list(close) OVER ({W_} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM bars) SELECT symbol, trade_date, CAST(list_position(l, list_max(l)) AS INTEGER) AS argmax, CAST(list_position(l, list_min(l)) AS INTEGER) AS argmin, len(list_filter(l, lambda x: x > 104)) > 0 AS any_high, len(list_filter(l, lambda x: x > 96)) = len(l) AS all_high, {{list_sum(l[-3:]) AS last3}}, {{list_max(l[1:5]) AS max5}} FROM c")
def sc06_arrays(spark, sf_dir):
    d = t(spark, sf_dir, "bars").select("symbol", "trade_date", F.collect_list("close").over(P.by_time().rowsBetween(-9, 0)).alias("l"))
    n = F.size("l")
    total = F.aggregate(F.slice("l", F.greatest(n - 2, F.lit(1)), F.lit(3)), F.lit(0.0), lambda a, x: a + x)
    return d.select("symbol", "trade_date", F.array_position("l", F.array_max("l")).cast("int").alias("argmax"), F.array_position("l", F.array_min("l")).cast("int").alias("argmin"), F.exists("l", lambda x: x > 104).alias("any_high"), F.forall("l", lambda x: x > 96).alias("all_high"), total.alias("last3"), F.array_max(F.slice("l", 1, 5)).alias("max5"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 9 END AS code, CASE WHEN event_type = 'click' THEN 5 WHEN event_type = 'purchase' THEN 7 ELSE 0 END AS merged FROM events")
def sc07_maps(spark, sf_dir):
    """Look-up with a default, and in two maps of which the second wins."""
    as_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    e, key = read(spark, sf_dir, "events"), F.col("event_type")
    first, second = {"click": 3, "purchase": 7}, {"click": 5}
    both = F.map_concat(F.map_filter(as_map(first), lambda k, v: ~k.isin(*second)), as_map(second))
    return e.select("event_id", F.coalesce(F.try_element_at(as_map({"click": 1, "view": 2}), key), F.lit(9)).alias("code"), F.coalesce(F.try_element_at(both, key), F.lit(0)).alias("merged"))


@query("x AS (SELECT event_type AS sector, CAST(json_extract_string(props, '$.k') AS INTEGER) AS heat, event_id FROM events) SELECT sector, max(heat) AS heat, arg_max(event_id, row(heat, event_id)) AS event_id, count(heat) AS n FROM x GROUP BY sector")
def sc08_json(spark, sf_dir):
    """Nested fields of JSON text; an array of themes built from it is exploded, and each sector keeps its hottest."""
    themes = F.array(F.struct(F.col("p.k").alias("heat"), F.array("event_type").alias("benefit_sectors")))
    e = read(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int")).select("event_id", F.explode(F.from_json(F.to_json(themes), "array<struct<heat:int,benefit_sectors:array<string>>>")).alias("theme"))
    flat = e.select("event_id", "theme.heat", F.explode("theme.benefit_sectors").alias("sector"))
    return flat.groupBy("sector").agg(F.max("heat").alias("heat"), F.max_by("event_id", F.struct("heat", "event_id")).alias("event_id"), F.count("heat").alias("n"))


@query("SELECT doc_id, TRY_CAST(substring(source, 4) AS INTEGER) AS number, TRY_CAST(source AS DOUBLE) AS none, coalesce(nullif(lang, 'en'), source, '?') AS label, {coalesce(nullif(CAST(n_chars AS DOUBLE), 0), -1) AS size} FROM documents")
def sc09_nulls(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr("try_cast(substring(source, 4) AS INT)").alias("number"), F.expr("try_cast(source AS DOUBLE)").alias("none"), F.coalesce(F.nullif("lang", F.lit("en")), "source", F.lit("?")).alias("label"), F.coalesce(F.nullif(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(-1.0)).alias("size"))


#: Ordered rules, the first that matches names the theme; words of the two moods.
THEMES = (("contact", r"@|\+[0-9]"), ("license", r"(?i)licensed under|all rights reserved"), ("table", r"\|"), ("shout", r"!!"))
GOOD, BAD = ("the", "de", "die"), ("!!", "|", "#")
_SUM = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


@query(f"x AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), y AS (SELECT doc_id, CASE {' '.join(f'WHEN regexp_matches(text, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for n, p in THEMES)} ELSE 'other' END AS theme, {_SUM(GOOD)} AS good, {_SUM(BAD)} AS bad FROM x) SELECT doc_id, theme, {{coalesce((good - bad) / nullif(good + bad, 0) * 100, 0) AS mood}} FROM y")
def sc10_text_rules(spark, sf_dir):
    x = F.coalesce("text", F.lit(""))
    theme = reduce(lambda c, r: c.when(x.rlike(r[1]), r[0]), THEMES, F).otherwise("other")
    hits = lambda words: reduce(lambda a, b: a + b, (F.lower(x).contains(w).cast("int") for w in words))
    good, bad = hits(GOOD), hits(BAD)
    return read(spark, sf_dir, "documents").select("doc_id", theme.alias("theme"), F.coalesce((good - bad) / F.nullif(good + bad, F.lit(0)) * 100, F.lit(0.0)).alias("mood"))
