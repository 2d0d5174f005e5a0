"""Files of bars: fixed-width binary records, JSON lines, nested documents, CSV logs; partitioned and incremental Parquet sinks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 32
#: Record of eight little-endian 32-bit integers: date yyyymmdd, prices times 100, amount, volume, reserved.
FIELDS = ("date", "open", "high", "low", "close", "amount", "vol", "reserved")


def _int(record: Column, k: int) -> Column:
    """Field k of a record, from its hex digits with the bytes turned round."""
    digits = F.hex(F.substring(record, 4 * k + 1, 4))
    turned = F.concat(*(F.substring(digits, p, 2) for p in (7, 5, 3, 1)))
    return F.conv(turned, 16, 10).cast("long")


def binary_bars(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, trade_date, open, high, low, close, amount, vol) of fixed-width files named by symbol; records without a date that exists are skipped."""
    return decoded_bars(spark.read.format("binaryFile").load(path))


def decoded_bars(files: DataFrame) -> DataFrame:
    """The bars of files (path, content), each named by its symbol; a last record that is cut off is skipped."""
    files = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("symbol"), "content", F.length("content").alias("length"))
    records = files.where(f"length >= {RECORD}").withColumn("k", F.explode(F.expr(f"sequence(0, cast(length div {RECORD} as int) - 1)")))
    record = F.expr(f"substring(content, k * {RECORD} + 1, {RECORD})")
    d = records.select("symbol", record.alias("r"))
    d = d.select("symbol", *(_int(F.col("r"), i).alias(f) for i, f in enumerate(FIELDS)))
    day = F.expr("try_to_date(lpad(cast(date as string), 8, '0'), 'yyyyMMdd')")
    return d.select("symbol", day.alias("trade_date"), *((F.col(c) / 100).alias(c) for c in ("open", "high", "low", "close")), F.col("amount").cast("double").alias("amount"), F.col("vol").cast("double").alias("vol")).where("trade_date IS NOT NULL")


def packed_bars(bars: DataFrame) -> DataFrame:
    """(path, content): each symbol's bars in order of date, as the records that `decoded_bars` reads."""
    little = lambda x: F.concat(*(F.substring(F.lpad(F.hex(x.cast("long")), 8, "0"), p, 2) for p in (7, 5, 3, 1)))
    cents = lambda c: F.round(F.col(c) * 100)
    fields = [F.date_format("trade_date", "yyyyMMdd").cast("long"), *map(cents, ("open", "high", "low", "close")), F.col("amount"), F.col("vol"), F.lit(0)]
    one = bars.select("symbol", F.struct("trade_date", F.concat(*map(little, fields)).alias("x")).alias("r"))
    return one.groupBy("symbol").agg(F.array_sort(F.collect_list("r")).alias("rs")).select(F.concat("symbol", F.lit(".day")).alias("path"), F.unhex(F.array_join(F.transform("rs", lambda r: r["x"]), "")).alias("content"))


#: Packed five-minute record: bit-packed date, minute of the day, five 32-bit floats, volume, four bytes of nothing.
PACKED = "<u2,<u2,<f4,<f4,<f4,<f4,<f4,<u4,<u4"


def minute_bars(files: DataFrame) -> DataFrame:
    """(symbol, at, open, high, low, close, amount, vol) of files (symbol, content) of packed records; times that do not exist are skipped."""

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for symbol, content in zip(b.column("symbol").to_pylist(), b.column("content").to_pylist()):
                r = np.frombuffer(content, PACKED, len(content) // 32)
                cols = [r[f"f{k}"] for k in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(r)), *(pa.array(c.astype(np.int32 if k < 2 else np.float64)) for k, c in enumerate(cols))], ["symbol", "day", "minute", "open", "high", "low", "close", "amount", "vol"])

    d = files.select("symbol", "content").mapInArrow(decode, "symbol string, day int, minute int, open double, high double, low double, close double, amount double, vol double")
    day, minute = F.col("day"), F.col("minute")
    date = F.expr("try_to_date(concat_ws('-', shiftright(day, 11) + 2004, lpad(cast(shiftright(day, 7) & 15 AS string), 2, '0'), lpad(cast(day & 31 AS string), 2, '0')), 'yyyy-MM-dd')")
    at = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + minute * 60)
    return d.withColumn("at", F.when(date.isNotNull() & (minute < 1440), at)).where("at IS NOT NULL").select("symbol", "at", *(F.round(c, 2).alias(c) for c in ("open", "high", "low", "close", "amount")), "vol")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def nested_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of documents {symbol, ts: {daily: [...]}}."""
    bar = "trade_date string, open double, high double, low double, close double, vol double, amount double"
    d = spark.read.schema(f"symbol string, ts struct<daily: array<struct<{bar.replace(' string', ': string').replace(' double', ': double')}>>>").json(path)
    return d.select("symbol", F.explode("ts.daily").alias("b")).select("symbol", F.to_date("b.trade_date", "yyyyMMdd").alias("trade_date"), *(f"b.{c}" for c in ("open", "high", "low", "close", "vol", "amount")))


def normalised(df: DataFrame, names: dict[str, str], numbers: list[str]) -> DataFrame:
    """Columns renamed to the canonical names, numbers coerced: what is no number, or not finite, is null."""
    d = df.withColumnsRenamed(names)
    finite = lambda c: F.expr(f"CASE WHEN isnan(try_cast(`{c}` AS DOUBLE)) OR abs(try_cast(`{c}` AS DOUBLE)) = double('infinity') THEN NULL ELSE try_cast(`{c}` AS DOUBLE) END")
    return d.withColumns({c: finite(c) for c in numbers if c in d.columns})


def write_by_month(df: DataFrame, path: str, at: str = "trade_date") -> None:
    """Parquet by month; months in `df` are replaced, others stay, so a repeated run changes nothing."""
    out = df.withColumn("ym", F.date_format(at, "yyyy-MM"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)


def newer(df: DataFrame, done: DataFrame, key: str = "symbol", at: str = "trade_date") -> DataFrame:
    """Rows of `df` after each key's last row in `done`."""
    mark = done.groupBy(key).agg(F.max(at).alias("__mark"))
    return df.join(mark, key, "left").where(F.col("__mark").isNull() | (F.col(at) > F.col("__mark"))).drop("__mark")
