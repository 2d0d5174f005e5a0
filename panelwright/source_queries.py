"""Registered queries of scans, sinks and streams: derived tables are written to the shared folder in each format and read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import channel
from .operators import panels as P
from .panel_queries import FACTS, W_, facts, query, t
from .sources import files
from .sources.fixtures import CTES, read
from .sources.scratch import folder, kept
from .streaming import bars as S

_SIGNALS = CTES["signals"].split(",\nsignals AS ")[1]
BRANDS = CTES["signals"].split("signals AS ")[0]


@query("SELECT symbol, trade_date, {close AS close} FROM bars WHERE trade_date BETWEEN DATE '1996-02-01' AND DATE '1997-05-31'")
def io01_date_range_scan(spark, sf_dir):
    """Files by month; the range prunes months and is pushed into those that stay."""
    path = folder(spark, "by-month")
    files.write_by_month(t(spark, sf_dir, "bars"), path)
    lo, hi = "1996-02-01", "1997-05-31"
    return spark.read.parquet(path).where(F.col("ym").between(lo[:7], hi[:7]) & F.col("trade_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).select("symbol", "trade_date", "close")


@query("SELECT symbol, count(*) AS n, {avg(close) AS mean} FROM bars GROUP BY symbol")
def io02_pruned_scan(spark, sf_dir):
    """Two columns of a table of eight are read."""
    return kept(t(spark, sf_dir, "bars"), "bars").select("symbol", "close").groupBy("symbol").agg(F.count("close").alias("n"), F.avg("close").alias("mean"))


@query("SELECT o_orderkey, symbol, {score AS score} FROM signals", "signals")
def io03_json_lines(spark, sf_dir):
    """JSON lines among which every tenth is cut off: the cut ones are skipped."""
    s = t(spark, sf_dir, "signals").select("o_orderkey", "symbol", "score")
    line = F.to_json(F.struct("*"))
    lines = s.select(line.alias("value")).union(s.where("o_orderkey % 10 = 0").select(F.expr("substring(to_json(struct(*)), 1, 20)")))
    path = folder(spark, "lines")
    lines.write.text(path)
    return files.json_lines(spark, path, "o_orderkey long, symbol string, score double").where("symbol IS NOT NULL")


@query("SELECT symbol, trade_date, {open AS open}, {high AS high}, {low AS low}, {close AS close}, {vol AS vol}, {amount AS amount} FROM bars")
def io04_nested_documents(spark, sf_dir):
    b = t(spark, sf_dir, "bars").withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))
    docs = b.groupBy("symbol").agg(F.struct(F.collect_list(F.struct("trade_date", "open", "high", "low", "close", "vol", "amount")).alias("daily")).alias("ts"))
    path = folder(spark, "nested")
    docs.write.json(path)
    return files.nested_bars(spark, path)


@query("SELECT o_orderkey, symbol, trade_date, {score AS score} FROM signals", "signals")
def io05_csv_log(spark, sf_dir):
    """A log with a header, appended to in two runs, read with a schema."""
    s, path = t(spark, sf_dir, "signals").select("o_orderkey", "symbol", "trade_date", "score"), folder(spark, "log")
    for half in (0, 1):
        s.where(f"o_orderkey % 2 = {half}").write.mode("append").option("header", True).csv(path)
    return spark.read.schema("o_orderkey long, symbol string, trade_date date, score double").option("header", True).csv(path)


@query("SELECT symbol, trade_date, {round(open * 100) / 100 AS open}, {round(high * 100) / 100 AS high}, {round(low * 100) / 100 AS low}, {round(close * 100) / 100 AS close}, {floor(amount) AS amount}, {vol AS vol} FROM bars")
def io06_binary_bars(spark, sf_dir):
    b = t(spark, sf_dir, "bars").select("symbol", "trade_date", *(F.expr(f"{c} + 1e-9").alias(c) for c in ("open", "high", "low", "close")), "amount", "vol")
    return files.decoded_bars(kept(files.packed_bars(b), "binary"))


@query("SELECT event_type AS symbol, ts_minute AS at, {CAST(value AS DOUBLE) AS close}, CAST(event_id % 1000 AS DOUBLE) AS vol FROM (SELECT *, date_trunc('minute', ts) AS ts_minute FROM events)", "bars")
def io07_packed_minutes(spark, sf_dir):
    """Events as packed records, one file a kind and day, decoded again."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", F.col("value").alias("px"), ((F.year("ts") - 2004) * 2048 + F.month("ts") * 128 + F.dayofmonth("ts")).alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))

    layout = files.PACKED

    def pack(table):
        import numpy as np
        import pyarrow as pa

        r = np.zeros(len(table), layout)
        r["f0"], r["f1"], r["f7"] = table.column("day").to_numpy(), table.column("minute").to_numpy(), table.column("event_id").to_numpy() % 1000
        for k in range(2, 7):
            r[f"f{k}"] = table.column("px").to_numpy()
        return pa.table({"symbol": [table.column("symbol")[0].as_py()], "content": pa.array([r.tobytes()], pa.binary())})

    packed = e.groupBy("symbol", "day").applyInArrow(pack, "symbol string, content binary")
    return files.minute_bars(kept(packed, "packed")).select("symbol", "at", "close", "vol")


@query("SELECT symbol, trade_date, {close AS close} FROM bars WHERE trade_date IN (SELECT DISTINCT trade_date FROM bars ORDER BY trade_date DESC LIMIT 20)")
def io08_last_days(spark, sf_dir):
    path = folder(spark, "by-month")
    files.write_by_month(t(spark, sf_dir, "bars"), path)
    d = spark.read.parquet(path)
    last = d.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(20)
    return d.join(F.broadcast(last), "trade_date", "left_semi").select("symbol", "trade_date", "close")


@query("SELECT strftime(trade_date, '%Y-%m') AS ym, count(*) AS n, {sum(close) AS total} FROM bars GROUP BY 1")
def io09_monthly_files(spark, sf_dir):
    """Written twice: months are replaced, so nothing is there twice."""
    path = folder(spark, "by-month")
    for _ in range(2):
        files.write_by_month(t(spark, sf_dir, "bars"), path)
    return spark.read.parquet(path).groupBy(F.col("ym").cast("string").alias("ym")).agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


@query(f"{FACTS}, g AS (SELECT industry, count(r_20) AS n, count(CASE WHEN r_20 > 0 THEN 1 END) AS wins FROM facts GROUP BY industry) SELECT '{{\"industry\":\"' || industry || '\",\"n\":' || n || ',\"wins\":' || wins || '}}' AS line FROM g".replace('{{"', '{"').replace("'}}'", "'}'"), "panel")
def io10_json_report(spark, sf_dir):
    g = facts(spark, sf_dir).groupBy("industry").agg(F.count("r_20").alias("n"), F.count_if(F.col("r_20") > 0).alias("wins"))
    path = folder(spark, "report")
    g.select(F.to_json(F.struct("industry", "n", "wins")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT symbol, count(*) AS n, CASE WHEN symbol < 'Brand#2' THEN 1 ELSE 2 END AS run FROM bars GROUP BY symbol")
def io11_skip_done_groups(spark, sf_dir):
    """A first run ends after some groups; the second one does those that are not there yet."""
    b, path = t(spark, sf_dir, "bars"), folder(spark, "groups")
    work = lambda d, run: d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run))
    work(b.where("symbol < 'Brand#2'"), 1).write.mode("append").parquet(path)
    done = kept(spark.read.parquet(path).select("symbol"), "done")
    work(b.join(done, "symbol", "left_anti"), 2).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT doc_id AS id, {TRY_CAST(substring(source, 4) AS DOUBLE) AS number}, {CAST(n_chars AS DOUBLE) AS volume} FROM documents")
def io12_normalised_columns(spark, sf_dir):
    raw = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ID"), F.expr("substring(source, 4)").alias("Nr."), F.col("n_chars").cast("string").alias("Vol"))
    return files.normalised(raw, {"ID": "id", "Nr.": "number", "Vol": "volume"}, ["number", "volume"])


@query("SELECT symbol, trade_date, {close AS close} FROM bars WHERE trade_date > DATE '1997-06-30' OR symbol = 'Brand#7'")
def io13_new_dates_only(spark, sf_dir):
    """Rows after each key's last row in what is there; of a key that is not there, all."""
    b = t(spark, sf_dir, "bars")
    done = kept(b.where("trade_date <= DATE '1997-06-30' AND symbol <> 'Brand#7'"), "done")
    return files.newer(b, done.select("symbol", F.lit("1997-06-30").cast("date").alias("trade_date"))).select("symbol", "trade_date", "close")


@query("SELECT symbol, count(*) AS n, max(trade_date) AS last FROM bars GROUP BY symbol")
def io14_append_after_mark(spark, sf_dir):
    """Packed records up to a date, then only those after each file's last record: no record twice."""
    b, path = t(spark, sf_dir, "bars"), folder(spark, "append")
    for part in (b.where("trade_date <= DATE '1996-12-31'"), b):
        there = files.decoded_bars(spark.read.schema("path string, content binary").parquet(path)) if part is b else part.where("false")
        new = files.newer(part, kept(there.select("symbol", "trade_date"), "marks"))
        files.packed_bars(new).write.mode("append").parquet(path)
    d = files.decoded_bars(spark.read.parquet(path))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("last"))


# Streams ---------------------------------------------------------------------------------------------------

_DAY = "SELECT event_type AS symbol, date_trunc('day', ts) AS start, arg_min(value, row(ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, value)) AS close, count(*) AS n FROM events"


def ticks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))


@query(f"l AS (SELECT date_trunc('day', max(ts)) AS d FROM events), a AS ({_DAY} WHERE ts < (SELECT d FROM l) GROUP BY ALL), b AS ({_DAY} WHERE ts >= (SELECT d FROM l) GROUP BY ALL) SELECT symbol, start, {{open AS open}}, {{high AS high}}, {{low AS low}}, {{close AS close}}, n, false AS provisional FROM a UNION ALL SELECT symbol, start, open, high, low, close, n, true FROM b")
def sm02_provisional_bar(spark, sf_dir):
    """Finished days' bars and the running day's provisional one, which gives way to a finished bar of that day."""
    d = ticks(spark, sf_dir)
    last = d.agg(F.date_trunc("day", F.max("ts")).alias("last"))  # one row
    d = d.join(F.broadcast(last))
    done = S.tumbling_bars(d.where("ts < last")).withColumn("provisional", F.lit(False))
    running = S.tumbling_bars(d.where("ts >= last")).withColumn("provisional", F.lit(True))
    seen_before = S.tumbling_bars(d.where("ts < last AND hour(ts) < 12")).withColumn("provisional", F.lit(True))
    return P.keep_last(done.unionByName(running).unionByName(seen_before), ["symbol", "start"], [F.col("provisional")])


@query("m AS (SELECT trade_date, avg(close) AS mc FROM bars GROUP BY trade_date) SELECT symbol, trade_date, {CASE WHEN day(trade_date) % 3 = 0 THEN mc ELSE close END AS close}, day(trade_date) % 3 = 0 AS patched FROM bars JOIN m USING (trade_date)")
def sm03_gap_patch(spark, sf_dir):
    """Days that the first source lacks come from a second one; where both have a day, the first wins."""
    b = t(spark, sf_dir, "bars")
    second = b.select("symbol", "trade_date").join(b.groupBy("trade_date").agg(F.avg("close").alias("close")), "trade_date").withColumn("patched", F.lit(True))
    first = b.where("day(trade_date) % 3 <> 0").select("symbol", "trade_date", "close").withColumn("patched", F.lit(False))
    return P.keep_last(first.unionByName(second), ["symbol", "trade_date"], [F.col("patched")])


@query("l AS (SELECT event_type AS symbol, quantile_cont(value, 0.5) AS level FROM events GROUP BY 1) SELECT event_type AS symbol, CASE WHEN abs(value / nullif(level, 0) - 1) > 2 THEN 'severe' WHEN abs(value / nullif(level, 0) - 1) > 0.8 THEN 'warning' ELSE 'normal' END AS state, count(*) AS n FROM events JOIN l ON event_type = symbol GROUP BY ALL")
def sm04_stream_against_levels(spark, sf_dir):
    """A stream of ticks, read from files until they end, beside a static table of levels."""
    d = ticks(spark, sf_dir)
    levels = d.groupBy("symbol").agg(F.expr("percentile(price, 0.5D)").alias("level"))
    source, out, state = folder(spark, "ticks"), folder(spark, "checked"), folder(spark, "state")
    d.write.parquet(source)
    stream = spark.readStream.schema(d.schema).parquet(source)
    S.drain(S.checked_against(stream, kept(levels, "levels"), 0.8, 2.0), out, state)
    return spark.read.parquet(out).groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"))


@query("")
def sm05_channel_walk(spark, sf_dir):
    """The channel walk on a stream that comes in two runs, the second one from the state of the first."""
    flags = channel.flagged(channel.inputs().apply(t(spark, sf_dir, "bars")))
    source, out, state = folder(spark, "flags"), folder(spark, "walk"), folder(spark, "state")
    for early in (True, False):
        flags.where((F.col("trade_date") <= F.lit("1998-06-30").cast("date")) == early).write.mode("append").parquet(source)
        S.drain(S.channel_walk(spark.readStream.schema(flags.schema).parquet(source)), out, state)
    return spark.read.parquet(out)


@query(f"{BRANDS}signals AS {_SIGNALS}, b AS (SELECT symbol, trade_date, close, row_number() OVER ({W_}) AS i FROM bars WHERE trade_date <= DATE '1997-12-31'), m AS (SELECT symbol, max(i) AS last FROM b GROUP BY symbol), s AS (SELECT o_orderkey, symbol, i, close FROM signals JOIN b USING (symbol, trade_date)), e AS (SELECT s.*, least(20, last - s.i) AS filled FROM s JOIN m USING (symbol)) SELECT o_orderkey, e.symbol, CAST(filled AS BIGINT) AS filled, CASE WHEN filled = 20 THEN 'closed' ELSE 'open' END AS status, {{100 * (b.close / e.close - 1) AS ret}} FROM e JOIN b ON b.symbol = e.symbol AND b.i = e.i + filled", "bars")
def sm06_arriving_outcomes(spark, sf_dir):
    """Signals and the bars that have come by a date: a signal is open until 20 bars came after its own."""
    b = t(spark, sf_dir, "bars").where("trade_date <= DATE '1997-12-31'")
    w = P.by_time()
    n = w.rowsBetween(1, 20)
    ahead = b.select("symbol", "trade_date", F.count("close").over(n).alias("filled"), (100 * (F.coalesce(F.last("close").over(n), F.col("close")) / F.col("close") - 1)).alias("ret"))
    d = t(spark, sf_dir, "signals").join(ahead, ["symbol", "trade_date"])
    return d.select("o_orderkey", "symbol", "filled", F.when(F.col("filled") == 20, "closed").otherwise("open").alias("status"), "ret")


@query(f"h AS (SELECT symbol, trade_date, vol, avg(vol) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m, stddev_samp(vol) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM bars) SELECT symbol, trade_date, {{CASE WHEN n < 30 OR s = 0 THEN 50.0 ELSE least(100.0, greatest(0.0, 55 + 18 * (vol - m) / s)) END AS score}} FROM h")
def sm07_running_distribution(spark, sf_dir):
    """A score set against the last 30 of its key; neutral until they are there."""
    f = P.by_time().rowsBetween(-29, 0)
    m, s, n = F.avg("vol").over(f), F.stddev_samp("vol").over(f), F.count(F.lit(1)).over(f)
    z = 55 + 18 * (F.col("vol") - m) / F.nullif(s, F.lit(0.0))
    return t(spark, sf_dir, "bars").select("symbol", "trade_date", F.when((n < 30) | (s == 0), 50.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), z))).alias("score"))


@query(f"w AS (SELECT symbol, trade_date, avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20 FROM bars) SELECT symbol, trade_date, {{ma20 AS ma20}} FROM w WHERE trade_date > DATE '1997-06-30'")
def sm08_features_on_append(spark, sf_dir):
    """Features of new rows only, from those rows and the 19 before them: what a micro-batch of new bars needs of the table."""
    b = t(spark, sf_dir, "bars")
    old, new = b.where("trade_date <= DATE '1997-06-30'"), b.where("trade_date > DATE '1997-06-30'")
    halo = old.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))).where("k <= 19").drop("k")
    d = halo.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
    return d.withColumn("ma20", F.avg("close").over(P.by_time().rowsBetween(-19, 0))).where("new").select("symbol", "trade_date", "ma20")
