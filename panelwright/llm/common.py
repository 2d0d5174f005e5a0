"""Helpers that several text operators share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of code points other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`). Unset, a temporary one in local mode; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="panelwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows, so that batches of whole documents stay a few MB. Set by the queries and the pipeline for their session, never by an operator."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def words_of(text: Column) -> Column:
    """array<string> of the words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(x: Column, use) -> Column:
    """`use(x)` with x computed once, however often `use` reads it."""
    return F.get(F.transform(F.array(x), use), 0)


def next_row(df: DataFrame, order: str, carried: list[str], per_range: int = 4000) -> DataFrame:
    """Each row with `next_<c>` of the row after it in descending numeric `order` (after the last: the first).

    No window over the whole table: rows are dealt into ranges of `order` of about `per_range`
    rows, each of which gets a copy of the next range's first row, and `lead` runs inside a range.
    Ranges are equal parts of the stretches between 129 quantiles, so their number has no
    limit; only one row per range, of three numbers, is ever sorted in one task. Rows with
    null `order` come last, in ranges by hash. Ties in `order` are in the order of a hash of
    the carried values, so reruns agree.
    """
    n, some = df.agg(F.count(F.lit(1)), F.count(order)).first()
    x, parts = F.col(order).cast("double"), max(1, -(-n // (128 * per_range)))
    at = F.lit(0).cast("long")
    if some > per_range:
        bounds = sorted(set(df.stat.approxQuantile(order, [i / 128 for i in range(129)], 1 / 1024)))
        low = F.array(*map(F.lit, bounds))

        def placed(stretch: Column) -> Column:
            a, b = F.get(low, stretch), F.get(low, stretch + 1)
            part = F.when(b > a, F.floor((x - a) / (b - a) * parts)).otherwise(0)
            return -(stretch * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))).cast("long")

        at = let(F.greatest(F.lit(0), F.least(F.lit(len(bounds) - 2), F.size(F.filter(low, lambda b: b <= x)) - 1)), placed)
    tie = F.xxhash64(*carried)
    parts = max(1, (n - some) // per_range)
    at = F.when(F.col(order).isNull(), 1 + F.least(F.lit(parts - 1), F.floor((tie / 2.0**64 + 0.5) * parts))).otherwise(at)
    dealt = df.withColumns({"__range": at, "__tie": tie})
    head = F.struct(F.col(order).alias("o"), F.bitwise_not("__tie").alias("t"))
    firsts = dealt.groupBy("__range").agg(F.max(head).alias("__head"))
    ring = Window.orderBy("__range")
    last = F.max("__range").over(Window.partitionBy(F.lit(0)))
    firsts = keep(firsts.select("__range", "__head", F.coalesce(F.lag("__range").over(ring), last).alias("__before")), "ranges")
    copies = dealt.join(firsts, "__range").where(F.col(order).eqNullSafe(F.col("__head.o")) & (F.bitwise_not("__tie") == F.col("__head.t")))
    both = dealt.withColumn("__copy", F.lit(False)).union(copies.select(*df.columns, F.col("__before").alias("__range"), "__tie", F.lit(True).alias("__copy")))
    w = Window.partitionBy("__range").orderBy("__copy", F.col(order).desc_nulls_last(), "__tie", *(F.col(c).asc_nulls_last() for c in carried))
    led = both.withColumn("__next", F.lead(F.struct(*carried)).over(w)).where("NOT __copy")
    return led.select(*df.columns, *(F.col("__next")[c].alias(f"next_{c}") for c in carried))
