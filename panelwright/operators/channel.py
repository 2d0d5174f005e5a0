"""Channel reversals: eight phases of a close against a smoothed channel, their scores and outcomes.

What a phase reacts to is computed by windows; only the walk from phase to phase is a fold, over four
flags a row and by symbol. `WALK` lists for each phase what ends it, the first that holds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lag, ratio, recursive, roll, roll2, wma
from .features import A14, PREV, ROW
from .spec import Stages

#: Fixed values. Of each phase: (flag or None, more rows than this in the phase, next phase). A close under the channel always leads to phase 1.
WALK = {
    "1": (("inside", 0, "2"), (None, 10, "0D")),
    "2": (("over", 0, "3B"), (None, 20, "3A"), ("weak", 5, "3A")),
    "3A": (("over", 0, "3B"),),
    "3B": (("topped", 0, "4A"), (None, 15, "4B")),
    "4A": (("under", 0, "0D"),),
    "4B": (("topped", 0, "4A"), ("above", 0, "4B"), (None, 20, "0U"), ("under", 0, "0D")),
    "0U": (("over", 0, "0U"), (None, 0, "0D")),
    "0D": (("over", 0, "0U"), (None, 0, "0D")),
}


def inputs() -> Stages:
    """Channel, RSI with its slope, volume ratio and flags of each bar."""
    first = ROW | PREV | {"h": roll("max", "high", 100, 20), "l": roll("min", "low", 100, 20), "vol_ratio": ratio("vol", roll("avg", "vol", 20, 10))}
    second = {"upper": wma("h", 60), "lower": wma("l", 60), "gain": "greatest(coalesce(close - pc, 0.0), 0.0)", "loss": "greatest(coalesce(pc - close, 0.0), 0.0)"}
    means = recursive(up=("gain", A14, "gain / 14"), dn=("loss", A14, "loss / 14"))
    third = {"middle": "(upper + lower) / 2", "rsi": f"100 * {ratio('up', 'up + dn')}", "out": "(CASE WHEN close > upper THEN 1 ELSE 0 END)"}
    last = {"rsi_slope": roll2("regr_slope", "rsi", "i", 5), "topped": f"(CASE WHEN out + {lag('out')} + {lag('out', 2)} = 3 THEN 1 ELSE 0 END)"}
    return Stages("bars", (first, second, *means, third, last), ("close", "upper", "lower", "middle", "rsi", "rsi_slope", "vol_ratio", "topped"), digits=9)


def next_phase(phase: str | None, days: int, was_over: bool | None, below: bool, flags: dict[str, bool]) -> tuple[str, int]:
    """The phase after a row and the rows in it, this one among them."""
    days += 1
    if below and phase != "1":
        return "1", 1
    if phase is None:
        return ("0U" if flags["over"] else "0D"), 1
    for flag, rows, then in WALK[phase]:
        if (flag is None or flags[flag]) and days > rows:
            turned = phase[0] == "0" and was_over is not None and was_over != flags["over"]
            return (then, days) if then == phase and not turned else (then, 1)
    return phase, days


FLAGS = ("below", "inside", "over", "under", "above", "topped", "weak")


def flagged(features: DataFrame) -> DataFrame:
    """(symbol, trade_date, flags) of the rows of `inputs` that have a channel."""
    c = F.col
    weak = F.coalesce((c("vol_ratio") < 0.8) & (c("rsi").isNull() | (c("rsi") < 35)), F.lit(False))
    made = (c("close") < c("lower"), c("close") >= c("lower"), c("close") > c("middle"), c("close") < c("middle"), c("close") > c("upper"), c("topped") == 1, weak)
    return features.where("middle IS NOT NULL").select("symbol", "trade_date", *(x.alias(n) for n, x in zip(FLAGS, made)))


def walked_frame(pdf, phase: str | None, days: int, was: bool | None):
    """The phases of one symbol's rows in order of date, after what came before; and where that leaves it."""
    pdf, out = pdf.sort_values("trade_date"), []
    for row in pdf[list(FLAGS)].itertuples(index=False):
        now = dict(zip(FLAGS, row))
        phase, days = next_phase(phase, days, was, now["below"], now)
        was = bool(now["over"])
        out.append((phase, days))
    return pdf.assign(phase=[p for p, _ in out], days=[d for _, d in out])[["symbol", "trade_date", "phase", "days"]], (phase, days, was)


def phases(features: DataFrame) -> DataFrame:
    """The rows of `inputs` with phase (null without a channel), days in it, place (-1 to 1) and score."""
    c = F.col

    def fold(pdf):
        return walked_frame(pdf, None, 0, None)[0]

    walked = flagged(features).groupBy("symbol").applyInPandas(fold, "symbol string, trade_date date, phase string, days int")
    d = features.join(walked, ["symbol", "trade_date"], "left")
    up, down = F.nullif(c("upper") - c("middle"), F.lit(0.0)), F.nullif(c("middle") - c("lower"), F.lit(0.0))
    place = F.when(c("close") >= c("middle"), F.least(F.lit(1.0), (c("close") - c("middle")) / up)).otherwise(F.greatest(F.lit(-1.0), (c("close") - c("middle")) / down))
    return d.withColumn("place", F.coalesce(place, F.lit(0.0))).withColumn("score", score())


def score() -> Column:
    """5 to 95 by phase, place, RSI, its slope and volume; 50 without a phase."""
    rsi, slope, vol = F.coalesce("rsi", F.lit(50.0)), F.coalesce("rsi_slope", F.lit(0.0)), F.coalesce("vol_ratio", F.lit(1.0))
    p, days, back = F.col("phase"), F.col("days"), 50 - 30 * F.col("place")
    add = lambda cond, x: F.when(cond, float(x)).otherwise(0.0)
    one = back + F.when(rsi < 20, 8.0).when(rsi < 30, 5.0).otherwise(0.0) + add(vol > 1.3, 5)
    two = back + F.when((rsi < 30) & (slope > 0), 8.0).when((rsi >= 30) & (slope > 1), 6.0).otherwise(0.0) + add(vol > 1.2, 4)
    three = 68 + F.when((rsi > 40) & (slope > 0.5), 8.0).when((rsi > 35) & (slope > 0), 4.0).otherwise(0.0) + add(vol > 1.2, 5)
    three = F.when((rsi > 40) & (slope > 1.0) & (vol > 1.2), F.greatest(three, F.lit(82.0))).otherwise(three)
    strong = F.least(F.lit(80.0), 72 + add((rsi > 50) & (slope > 0), 3) + add(vol > 1.5, 3) - add(days > 5, 5))
    rest = F.least(F.lit(88.0), 78 + add(vol > 1.0, 4) + add((rsi > 45) & (slope > 0), 4) - add(days > 15, 5))
    out = F.when(p.isNull(), 50.0).when(p.isin("0U", "0D"), back).when(p == "1", one).when(p == "2", two).when(p == "3A", back - 5 - add(rsi < 30, 3)).when(p == "3B", three).when(p == "4A", strong).otherwise(rest)
    return F.greatest(F.lit(5.0), F.least(F.lit(95.0), out))
