"""Streams of ticks and bars: tumbling bars with a watermark, a stream-static anomaly check, a keyed state machine."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.channel import walked_frame
from ..operators.folds import next_phase


def tumbling_bars(ticks: DataFrame, width: str = "1 day", late: str = "2 days", at: str = "ts", key: str = "symbol", price: str = "price") -> DataFrame:
    """Open, high, low, close and count of each key and window; ticks later than the watermark are dropped. Works on batches, too."""
    w = ticks.withWatermark(at, late).groupBy(F.col(key), F.window(at, width))
    tie = F.struct(at, price)
    bars = w.agg(F.min_by(price, tie).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, tie).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select(key, F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def checked_against(ticks: DataFrame, levels: DataFrame, warn: float, severe: float, key: str = "symbol", price: str = "price") -> DataFrame:
    """Ticks beside a static table of levels, with the class of their distance."""
    move = F.abs(F.col(price) / F.nullif(F.col("level"), F.lit(0.0)) - 1)
    return ticks.join(levels, key, "left").withColumn("state", F.when(move > severe, "severe").when(move > warn, "warning").otherwise("normal"))


def phases(features: DataFrame) -> DataFrame:
    """(symbol, seq, phase, days) of a stream of (symbol, seq, place, slope): the channel walk, its state kept by key."""
    def step(key, frames, state):
        import pandas as pd

        phase, days = state.get if state.exists else (0, 0)
        for pdf in frames:
            out = []
            for seq, place, slope in pdf.sort_values("seq")[["seq", "place", "slope"]].itertuples(index=False):
                phase, days = next_phase(phase, days, None if place != place else place, None if slope != slope else slope)
                out.append((key[0], seq, phase, days))
            yield pd.DataFrame(out, columns=["symbol", "seq", "phase", "days"])
        state.update((phase, days))

    return features.groupBy("symbol").applyInPandasWithState(step, "symbol string, seq long, phase int, days int", "phase int, days int", "append", "NoTimeout")


def channel_walk(flags: DataFrame) -> DataFrame:
    """(symbol, trade_date, phase, days) of a stream of `channel.flagged` rows: the eight-phase walk, its state kept by symbol with the last date; a row at or before it is left out, as the walk has gone by."""
    def step(key, frames, state):
        import pandas as pd

        phase, days, was, last = state.get if state.exists else (None, 0, None, "")
        rows = pd.concat(list(frames))
        rows = rows[rows["trade_date"].map(str) > last]
        if len(rows):
            frame, (phase, days, was) = walked_frame(rows, phase, days, was)
            state.update((phase, days, was, str(rows["trade_date"].max())))
            yield frame

    return flags.groupBy("symbol").applyInPandasWithState(step, "symbol string, trade_date date, phase string, days int", "phase string, days int, was boolean, last string", "append", "NoTimeout")


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there into Parquet files, then stops."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
