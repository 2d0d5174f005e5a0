"""Streams whose results change as rows arrive: provisional bars, features of new rows, outcomes of open signals, running distributions.

What a micro-batch writes goes to a folder of its own number, so that a batch run again after a failure replaces its own
rows, and readers take the row of the highest batch for each key: a keyed upsert without rewriting older files. `compacted`
merges batches. Rows of a key have to come in order of date; a row at or before the key's last date is left
out, as its results are final, and so no order of batches can change a result silently.
"""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows after its own bar at which a signal's outcome is noted; the last one closes it.
STEPS = (1, 2, 3, 5, 10, 20)
#: Rows over which the lowest and highest returns of a signal are kept.
SPANS = (5, 10)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# The process in which Spark starts a stateful processor has not the caller's import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_batch(d: DataFrame, path: str, batch: int) -> None:
    d.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches' rows with their batch number; none before the first batch."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)


def latest(d: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row of the highest batch."""
    values = [c for c in d.columns if c not in keys and c != "batch"]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")


def compacted(spark: SparkSession, path: str, schema: str, keys: list[str], into: str) -> None:
    """Writes `latest` of all batches as one batch, numbered as the last, of a new folder."""
    d = batches(spark, path, schema)
    top = d.agg(F.max("batch")).first()[0]
    if top is not None:
        write_batch(latest(d, keys), into, top)


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Takes in what has arrived, batch by batch, and stops. State is kept in RocksDB, which stateful processors need."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


# Provisional bars ------------------------------------------------------------------------------------------

BAR = "symbol string, start timestamp, open double, high double, low double, close double, n long"


def follow_bars(ticks: DataFrame, path: str, checkpoint: str, width: str = "1 day", late: str = "2 days") -> None:
    """Bars of a stream of (symbol, ts, price), upserted with every batch that has ticks of theirs; ticks later than the watermark are dropped."""
    tie = F.struct("ts", "price")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width)).agg(F.min_by("price", tie).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", tie).alias("close"), F.count(F.lit(1)).alias("n"))
    run(bars.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "n"), checkpoint, lambda d, i: write_batch(d, path, i))


def followed_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars as they stand, those of the last day provisional."""
    d = latest(batches(spark, path, BAR), ["symbol", "start"])
    last = d.agg(F.max("start").alias("last"))  # one row
    return d.join(F.broadcast(last)).withColumn("provisional", F.col("start") == F.col("last")).drop("last")


# Features of new rows --------------------------------------------------------------------------------------


def follow_features(bars: DataFrame, path: str, halo: str, checkpoint: str, features: Callable[[DataFrame], DataFrame], rows: int) -> None:
    """`features` of a stream of bars (symbol, trade_date, ...), new rows only: each batch sees its rows and the `rows` bars before them.

    The halo is a small table of its own, each symbol's last `rows` bars after each batch; no batch reads older bars.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)

    def write(d: DataFrame, i: int) -> None:
        spark = d.sparkSession
        seen = batches(spark, halo, schema).where(F.col("batch") < i)
        seen = seen.withColumn("top", F.max("batch").over(_by("symbol"))).where("batch = top").drop("batch", "top")
        last = seen.groupBy("symbol").agg(F.max("trade_date").alias("__last"))
        new = d.join(last, "symbol", "left").where("__last IS NULL OR trade_date > __last").drop("__last").select(*bars.columns)
        both = seen.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
        write_batch(features(both).where("__new").drop("__new"), path, i)
        newest = both.withColumn("__k", F.row_number().over(_by("symbol").orderBy(F.desc("trade_date"))))
        # Only symbols with new rows: the others' last halo stays theirs.
        newest = newest.withColumn("__any", F.max("__new").over(_by("symbol"))).where(f"__k <= {rows} AND __any")
        write_batch(newest.select(*bars.columns), halo, i)

    run(bars, checkpoint, write, "append")


def _hold(state, rows: list[tuple]) -> None:
    """Puts rows into a list state, which can't hold none."""
    state.put(rows) if rows else state.clear()


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


# Outcomes of signals ---------------------------------------------------------------------------------------

SIGNAL = "id long, symbol string, trade_date date, base double, filled int, status string, ret double, " + ", ".join([*(f"ret_{s} double" for s in STEPS), *(f"{k}_{n} double" for n in SPANS for k in ("max_drawdown", "max_gain"))])
_FIELDS = [x.split()[0] for x in SIGNAL.split(", ")]


#: Open signals in state: those of one date that have come to stand alike, with all their ids.
HELD = SIGNAL.replace("id long", "ids array<bigint>")


class Outcomes(StatefulProcessor):
    """State of a symbol: its open signals, and its last bars for signals that come after their bar.

    Signals of one date that come in one batch have one outcome: bars pass by dates, not by signals.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", HELD)
        self.ring = handle.getListState("ring", "trade_date date, close double")

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import numpy as np
        import pandas as pd

        held = [dict(zip(["ids", *_FIELDS[1:]], x)) for x in self.open.get()] if self.open.exists() else []
        ring = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        arrived = pd.concat(list(rows))
        is_signal = arrived["is_signal"] == 1
        # Equal ids are one signal, the later one.
        signals = arrived.loc[is_signal, ["trade_date", "id"]].sort_values(["trade_date", "id"]).drop_duplicates("id", keep="last")
        again = signals["id"].to_numpy(np.int64)
        for s in held:
            s["ids"] = np.asarray(s["ids"], np.int64)
            s["ids"] = s["ids"][~np.isin(s["ids"], again)]
        of_day = {day: ids.to_numpy(np.int64) for day, ids in signals.groupby("trade_date")["id"]}
        steps = [(day, 0, float(close)) for day, close in arrived.loc[~is_signal, ["trade_date", "close"]].itertuples(index=False)] + [(day, 1, 0.0) for day in of_day]
        touched: set[int] = set()
        for day, new, close in sorted(steps, key=lambda x: x[:2]):
            if new:
                s = dict.fromkeys(_FIELDS[1:]) | {"ids": of_day[day], "symbol": key[0], "trade_date": day, "filled": 0, "status": "waiting"}
                touched.add(len(held))
                held.append(s)
                if len(ring) > STEPS[-1] and day < ring[0][0]:
                    s["status"] = "too_late"
                for at, price in ring:  # the bars it has missed
                    self.passed(s, at, price)
            elif not ring or day > ring[-1][0]:
                ring = [*ring[-STEPS[-1] :], (day, close)]
                for i, s in enumerate(held):
                    if s["status"] in ("waiting", "open"):
                        self.passed(s, day, close)
                        touched.add(i)
        _hold(self.open, [(s["ids"].tolist(), *(s[f] for f in _FIELDS[1:])) for s in held if s["status"] in ("waiting", "open") and len(s["ids"])])
        _hold(self.ring, ring)
        out = [held[i] for i in sorted(touched)]
        sizes = [len(s["ids"]) for s in out]
        made = pd.DataFrame([[s[f] for f in _FIELDS[1:]] for s in out], columns=_FIELDS[1:]).loc[np.repeat(np.arange(len(out)), sizes)].reset_index(drop=True)
        made.insert(0, "id", np.concatenate([s["ids"] for s in out]) if out else np.zeros(0, np.int64))
        yield made

    @staticmethod
    def passed(s: dict, day, close: float) -> None:
        """A bar of the symbol goes by an unfinished signal."""
        if s["status"] == "waiting":
            if day == s["trade_date"]:
                s.update(base=close, status="open", ret=0.0)
            elif day > s["trade_date"]:
                s["status"] = "no_bar"
            return
        if s["status"] != "open" or day <= s["trade_date"]:
            return
        s["filled"] += 1
        s["ret"] = ret = 100 * (close / s["base"] - 1)
        if s["filled"] in STEPS:
            s[f"ret_{s['filled']}"] = ret
        for n in SPANS:
            if s["filled"] <= n:
                s[f"max_drawdown_{n}"] = ret if s["filled"] == 1 else min(ret, s[f"max_drawdown_{n}"])
                s[f"max_gain_{n}"] = ret if s["filled"] == 1 else max(ret, s[f"max_gain_{n}"])
        if s["filled"] == STEPS[-1]:
            s["status"] = "closed"

    def close(self) -> None:
        pass


def follow_outcomes(events: DataFrame, path: str, checkpoint: str) -> None:
    """Outcomes of signals as bars arrive, upserted by signal, from a stream of (symbol, trade_date, is_signal, id, close): bars and signals in one.

    A signal waits for its date's bar, is open until 20 bars came after it, and then closed. One that arrives after its bar takes up the bars it missed, of the
    last 20; before those it is too_late. A date without a bar gives no_bar. Equal ids are one signal, the later one. Bars at or before a symbol's last bar are left out.
    """
    run(events.groupBy("symbol").transformWithStateInPandas(Outcomes(), SIGNAL, "Update", "None"), checkpoint, lambda d, i: write_batch(d, path, i))


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Every signal as it stands; drawdown and gain of a span only when it is over."""
    d = latest(batches(spark, path, SIGNAL), ["id"])
    return d.withColumns({f"{k}_{n}": F.when(F.col("filled") >= n, F.col(f"{k}_{n}")) for n in SPANS for k in ("max_drawdown", "max_gain")})


# Running distributions -------------------------------------------------------------------------------------

SCORE = "symbol string, trade_date date, raw double, score double, reason string"


class Stretched(StatefulProcessor):
    """State of a key: its last scores, and their last date."""

    def __init__(self, keep: int, least: int, narrow: float, mean: float, spread: float):
        self.keep, self.least, self.narrow, self.mean, self.spread = keep, least, narrow, mean, spread

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "trade_date date, raw double")

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import statistics

        import pandas as pd

        history = [tuple(x) for x in self.history.get()] if self.history.exists() else []
        out = []
        for day, raw in pd.concat(list(rows)).sort_values(["trade_date", "raw"])[["trade_date", "raw"]].itertuples(index=False):
            if raw != raw or history and day <= history[-1][0]:
                continue
            history = [*history[1 - self.keep :], (day, float(raw))] if self.keep > 1 else [(day, float(raw))]
            values = [x for _, x in history]
            score, reason = raw, "cold_start"
            if len(values) >= self.least:
                sigma, reason = statistics.stdev(values), "sigma_ok"
                if sigma < self.narrow:
                    score, reason = self.mean + (raw - statistics.mean(values)) / max(sigma, 0.01) * self.spread, "stretched"
                    score = max(5.0, min(95.0, score))
            out.append((key[0], day, raw, score, reason))
        _hold(self.history, history)
        yield pd.DataFrame(out, columns=["symbol", "trade_date", "raw", "score", "reason"])

    def close(self) -> None:
        pass


def follow_scores(scores: DataFrame, path: str, checkpoint: str, keep: int = 200, least: int = 30, narrow: float = 12.0, mean: float = 55.0, spread: float = 18.0) -> None:
    """Scores of a stream of (symbol, trade_date, raw), stretched to a mean and spread where the last `keep` of their key lie close together.

    Fewer than `least` scores, the present one included, or a deviation of `narrow` and more leave a score as it is. Null scores are left out.
    """
    run(scores.groupBy("symbol").transformWithStateInPandas(Stretched(keep, least, narrow, mean, spread), SCORE, "Append", "None"), checkpoint, lambda d, i: write_batch(d, path, i), "append")
