"""Panels derived from the order tables: weekly bars per brand, tiered money flow, attributes, market series, signals, holdings.

`TABLES` makes each as a DataFrame; `CTES` holds the same definitions as SQL text for checking.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Total order of the lines of a bar, which has ties in time.
TIE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
TIERS = (("sm", 0, 26_700), ("md", 26_700, 53_000), ("lg", 53_000, 79_500), ("elg", 79_500, 1e12))
SIDES = (("buy", "O"), ("sell", "F"))
CAP_FACTORS = (0.05, 0.1, 0.3, 1.0, 3.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return d.select(F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"), *TIE, "l_quantity", "l_linestatus", F.round(100 + 2 * (F.log(F.col("l_extendedprice") / F.col("l_quantity")) - 7.6), 6).alias("px"))


def _bar_cells() -> list:
    tie = F.struct(*TIE)
    return [
        F.min_by("px", tie).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", tie).alias("close"),
        F.sum("l_quantity").cast("double").alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    ]


def _flow_cells() -> list:
    x, cells = F.col("l_extendedprice"), []
    for side, status in SIDES:
        for tier, lo, hi in TIERS:
            cells.append(F.round(F.sum(F.when((F.col("l_linestatus") == status) & (x >= lo) & (x < hi), x).otherwise(0.0)), 2).alias(f"{side}_{tier}_amount"))
    return cells


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("symbol", "trade_date").agg(*_bar_cells())


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("symbol", "trade_date").agg(*_flow_cells())


def panel(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    """Bars (`b`, if they are there already) with industry, total_mv and pe: one aggregate and one window, no second scan."""
    b = bars(spark, sf_dir) if b is None else b
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().selectExpr("symbol", "row_number() OVER (ORDER BY symbol) - 1 AS r")
    factor = F.element_at(F.array(*map(F.lit, CAP_FACTORS)), (F.floor(F.col("r") / 5) % 5 + 1).cast("int"))
    d = b.join(brands, "symbol")
    d = d.withColumn("mv", F.expr("sum(amount) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)") * factor / 1e4)
    return d.select(*b.columns, F.concat(F.lit("I"), (F.col("r") % 5).cast("int").cast("string")).alias("industry"), F.col("mv").alias("total_mv"), (F.col("vol") % 140 - 20).alias("pe"))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """industry, total_mv and pe of each bar."""
    return panel(spark, sf_dir).select("symbol", "trade_date", "industry", "total_mv", "pe")


def panel_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and flow cells of one aggregate."""
    return lines(spark, sf_dir).groupBy("symbol", "trade_date").agg(*_bar_cells(), *_flow_cells())


def market(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    """The equal-weight market series of all bars (`b`, if they are there already), as bars of the one symbol INDEX."""
    d = (bars(spark, sf_dir) if b is None else b).groupBy("trade_date").agg(*(F.round(F.avg(c), 8).alias(c) for c in ("open", "high", "low", "close")), F.sum("vol").alias("vol"), F.round(F.sum("amount"), 2).alias("amount"))
    return d.select(F.lit("INDEX").alias("symbol"), *d.columns)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().selectExpr("symbol", "row_number() OVER (ORDER BY symbol) - 1 AS r")
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("r"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("trade_date"), F.round(F.col("o_totalprice") % 100, 4).alias("score"))
    return o.join(F.broadcast(brands), "r").select("o_orderkey", "symbol", "trade_date", "score")


def holdings(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    d = lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("fund"), "symbol").agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"))
    return d.withColumn("k", F.expr("row_number() OVER (PARTITION BY fund ORDER BY weight DESC, symbol)")).where(f"k <= {top}").select("fund", "symbol", "weight", F.col("k").cast("int").alias("k"))


TABLES = {f.__name__: f for f in (bars, flow, dims, panel, panel_flow, market, signals, holdings)}

_TIE = ", ".join(TIE)
_CELLS = ", ".join(f"round(sum(CASE WHEN l_linestatus = '{s}' AND l_extendedprice >= {lo} AND l_extendedprice < {hi:.0f} THEN l_extendedprice ELSE 0.0 END), 2) AS {side}_{tier}_amount" for side, s in SIDES for tier, lo, hi in TIERS)
_BRANDS = "brands AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS r FROM (SELECT DISTINCT p_brand AS symbol FROM part))"
_LINES = f"lines AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, {_TIE}, l_quantity, l_linestatus, round(100 + 2 * (ln(l_extendedprice / l_quantity) - 7.6), 6) AS px FROM lineitem JOIN part ON l_partkey = p_partkey)"
_BARS = f"{_LINES},\nbars AS (SELECT symbol, trade_date, arg_min(px, row({_TIE})) AS open, max(px) AS high, min(px) AS low, arg_max(px, row({_TIE})) AS close, CAST(sum(l_quantity) AS DOUBLE) AS vol, round(sum(l_extendedprice), 2) AS amount FROM lines GROUP BY ALL)"
_FLOW = f"flow AS (SELECT symbol, trade_date, {_CELLS} FROM lines GROUP BY ALL)"
_DIMS = f"""{_BRANDS},
dims AS (SELECT symbol, trade_date, 'I' || CAST(r % 5 AS VARCHAR) AS industry, (sum(amount) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * (CASE (r // 5) % 5 {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(CAP_FACTORS))} END) / 1e4) AS total_mv, vol % 140 - 20 AS pe FROM bars JOIN brands USING (symbol))"""
CTES = {
    "bars": _BARS,
    "flow": f"{_LINES},\n{_FLOW}",
    "dims": f"{_BARS},\n{_DIMS}",
    "panel": f"{_BARS},\n{_DIMS},\npanel AS (SELECT * FROM bars JOIN dims USING (symbol, trade_date))",
    "panel_flow": f"{_BARS},\n{_FLOW},\npanel_flow AS (SELECT * FROM bars JOIN flow USING (symbol, trade_date))",
    "market": f"{_BARS},\nmarket AS (SELECT 'INDEX' AS symbol, trade_date, {', '.join(f'round(avg({c}), 8) AS {c}' for c in ('open', 'high', 'low', 'close'))}, sum(vol) AS vol, round(sum(amount), 2) AS amount FROM bars GROUP BY trade_date)",
    "signals": f"{_BRANDS},\nsignals AS (SELECT o_orderkey, symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS trade_date, round(o_totalprice % 100, 4) AS score FROM orders JOIN brands ON o_custkey % 25 = r)",
    "holdings": f"{_LINES},\nholdings AS (SELECT * FROM (SELECT fund, symbol, weight, CAST(row_number() OVER (PARTITION BY fund ORDER BY weight DESC, symbol) AS INTEGER) AS k FROM (SELECT l_suppkey AS fund, symbol, round(sum(l_extendedprice), 2) AS weight FROM lines GROUP BY ALL)) WHERE k <= 5)",
}
