"""Registered queries of streams that take in their rows in several runs; what they end with is what SQL finds in the whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .operators import panels as P
from .panel_queries import W_, query, t
from .source_queries import _DAY, _SIGNALS, BRANDS, ticks
from .sources.scratch import folder, kept
from .streaming import live

STEPS = [f"DATE '{d}'" for d in ("1996-06-30", "1998-03-31")]
#: The runs of a stream by its rows' dates.
PART = f"CASE WHEN trade_date <= {STEPS[0]} THEN 0 WHEN trade_date <= {STEPS[1]} THEN 1 ELSE 2 END"


def in_runs(d, part: str, take) -> None:
    """Writes the rows of each part, in turn, into the folder that the stream reads, and lets `take` run the stream over what is new."""
    spark = d.sparkSession
    source = folder(spark, "arriving")
    d = kept(d.withColumn("__part", F.expr(part)), "parts")
    schema = d.drop("__part").schema
    for k in range(3):
        d.where(f"__part = {k}").drop("__part").write.mode("append").parquet(source)
        take(spark.readStream.schema(schema).parquet(source))


_LATE = "(SELECT date_trunc('day', max(ts)) AS d FROM events)"


@query(f"l AS {_LATE} SELECT symbol, start, {{open AS open}}, {{high AS high}}, {{low AS low}}, {{close AS close}}, n, start = (SELECT d FROM l) AS provisional FROM ({_DAY} GROUP BY ALL)")
def sm02_live_bars(spark, sf_dir):
    """Bars followed over three runs: the last day's ticks come in the second and third, with late ones of the day before in the third; each run's bars replace those before."""
    d = ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    last = d.agg(F.date_trunc("day", F.max("ts")).alias("last"))  # one row
    path, state = folder(spark, "bars"), folder(spark, "state")
    d = d.join(F.broadcast(last)).withColumn("lag", (F.unix_timestamp("last") - F.unix_timestamp("ts")) / 86400)
    part = "CASE WHEN lag > 1 THEN 0 WHEN lag > 0 AND pmod(xxhash64(ts, price), 7) > 0 OR lag <= 0 AND hour(ts) < 12 THEN 1 ELSE 2 END"
    in_runs(d.drop("last"), part, lambda s: live.follow_bars(s.select("symbol", "ts", "price"), path, state))
    return live.followed_bars(spark, path).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"SELECT symbol, trade_date, {{avg(close) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20}}, {{close / max(high) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS below}} FROM bars")
def sm08_live_features(spark, sf_dir):
    """Features of bars that come in three runs, each seeing its rows and the 19 before them."""
    path, halo, state = folder(spark, "features"), folder(spark, "halo"), folder(spark, "state")
    w = P.by_time().rowsBetween(-19, 0)
    made = lambda d: d.select("symbol", "trade_date", F.avg("close").over(w).alias("ma20"), (F.col("close") / F.max("high").over(w) - 1).alias("below"), "__new")
    in_runs(t(spark, sf_dir, "bars").select("symbol", "trade_date", "high", "close"), PART, lambda s: live.follow_features(s, path, halo, state, made, 19))
    return live.batches(spark, path, "symbol string, trade_date date, ma20 double, below double").drop("batch")


_BACK = lambda agg, n: f"CASE WHEN filled >= {n} THEN (SELECT {agg}(100 * (x.close / e.close - 1)) FROM b x WHERE x.symbol = e.symbol AND x.i BETWEEN e.i + 1 AND e.i + {n}) END"
_AT = lambda n: f"(SELECT 100 * (x.close / e.close - 1) FROM b x WHERE x.symbol = e.symbol AND x.i = e.i + {n})"


@query(f"{BRANDS}signals AS {_SIGNALS}, b AS (SELECT symbol, trade_date, close, row_number() OVER ({W_}) AS i FROM bars), m AS (SELECT symbol, max(i) AS last FROM b GROUP BY symbol), e AS (SELECT o_orderkey, s.symbol, s.trade_date, i, close, least(20, last - i) AS filled FROM signals s JOIN b USING (symbol, trade_date) JOIN m USING (symbol)) SELECT o_orderkey AS id, symbol, trade_date, CAST(filled AS INTEGER) AS filled, CASE WHEN filled = 20 THEN 'closed' ELSE 'open' END AS status, {{close AS base}}, {', '.join('{' + f'{_AT(n)} AS ret_{n}' + '}' for n in live.STEPS)}, {', '.join('{' + f'{_BACK(a, n)} AS {k}_{n}' + '}' for n in live.SPANS for k, a in (('max_drawdown', 'min'), ('max_gain', 'max')))} FROM e", "bars")
def sm06_live_outcomes(spark, sf_dir):
    """Outcomes of signals followed over three runs of bars and signals: open ones are filled on by later runs until 20 bars are there."""
    path, state = folder(spark, "outcomes"), folder(spark, "state")
    bars = t(spark, sf_dir, "bars").select("symbol", "trade_date", F.lit(0).alias("is_signal"), F.lit(-1).cast("long").alias("id"), "close")
    signals = t(spark, sf_dir, "signals").select("symbol", "trade_date", F.lit(1).alias("is_signal"), F.col("o_orderkey").cast("long").alias("id"), F.lit(None).cast("double").alias("close"))
    in_runs(bars.unionByName(signals), PART, lambda s: live.follow_outcomes(s, path, state))
    return live.outcomes(spark, path).where("status IN ('open', 'closed')").drop("ret")


_F60 = f"({W_} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(f"s AS (SELECT symbol, trade_date, 35 + vol % 31 AS raw FROM bars), h AS (SELECT *, avg(raw) OVER {_F60} AS m, stddev_samp(raw) OVER {_F60} AS s, count(*) OVER {_F60} AS n FROM s) SELECT symbol, trade_date, {{raw AS raw}}, {{CASE WHEN n < 30 OR round(s, 9) >= 9 THEN raw ELSE greatest(5.0, least(95.0, 55 + 18 * (raw - m) / greatest(s, 0.01))) END AS score}}, CASE WHEN n < 30 THEN 'cold_start' WHEN round(s, 9) >= 9 THEN 'sigma_ok' ELSE 'stretched' END AS reason FROM h")
def sm07_live_scores(spark, sf_dir):
    """Scores that come in three runs, each against the last 60 of its symbol."""
    path, state = folder(spark, "scores"), folder(spark, "state")
    d = t(spark, sf_dir, "bars").select("symbol", "trade_date", (35 + F.col("vol") % 31).alias("raw"))
    in_runs(d, PART, lambda s: live.follow_scores(s, path, state, keep=60, narrow=9.0))
    return live.batches(spark, path, live.SCORE).drop("batch")
