"""Shapes of the last rows of each bar: chart patterns of up to 60 rows and how firmly a level was broken.

Each row carries its own frame as one array of at most 60 bars, made by one window over (symbol, date); all
else are expressions over that array, so a family costs one exchange and one sort whatever a symbol's length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import back, over, recursive
from .features import A12, A14, A26, PREV, ROW
from .panels import by_time
from .spec import Stages

#: Rows of a frame, rows over which a break is judged, rows on each side of a turning point.
FRAME, RECENT, SIDE = 60, 20, 5


def framed(bars: DataFrame, rows: int = FRAME) -> DataFrame:
    """(symbol, trade_date, k, h, l, c, v): the last rows' highs, lows, closes and volumes, oldest first, and how many."""
    d = bars.select("symbol", "trade_date", F.collect_list(F.struct("high", "low", "close", "vol")).over(by_time().rowsBetween(1 - rows, 0)).alias("f"))
    return d.select("symbol", "trade_date", F.size("f").alias("k"), *(F.col(f"f.{name}").alias(c) for c, name in (("h", "high"), ("l", "low"), ("c", "close"), ("v", "vol"))))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def weighed(a: Column, weight) -> Column:
    """The sum of weight(x) * y over an array, x its places from -(k - 1) / 2 to (k - 1) / 2."""
    mid = (F.size(a) - 1) / 2
    return total(F.transform(a, lambda y, j: weight(j - mid) * y))


def slope(a: Column) -> Column:
    """Least-squares slope of an array over its places: their squares sum to k (k^2 - 1) / 12."""
    k = F.size(a).cast("double")
    return weighed(a, lambda x: x) / F.nullif(k * (k * k - 1) / 12, F.lit(0.0))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def digits(x: Column, n: int = 9) -> Column:
    return F.round(x, n)


def last(a: Column) -> Column:
    return F.element_at(a, -1)


def broken(d: DataFrame, level: str, into: str, up: bool, firm: int = 2, surge: float = 1.3) -> DataFrame:
    """`d` with `into`: struct of rows beyond `level` up to now, volume ratio of the row that broke it, strength (0 to 100), confirmed, kind.

    Strength counts rows beyond (10 each, 30 at most), a body across the level (20), volume (20), a test of it again (15) and a
    distance of 2 % (15); a wick across it has 10. Confirmed after `firm` rows. Null without a level.
    """
    x, n = F.col(level), F.least(F.col("k"), F.lit(RECENT))
    recent = lambda c: F.slice(c, F.size(c) - n + 1, n)
    d = d.withColumns({f"__{c}": recent(F.col(c)) for c in "hlcv"})
    h, l, c, v = (F.col(f"__{c}") for c in "hlcv")
    beyond = (lambda y: y > x) if up else (lambda y: y < x)
    short = F.array_position(F.transform(F.reverse(c), beyond), F.lit(False)).cast("int")
    d = d.withColumn("__rows", F.when(short == 0, F.size(c)).otherwise(short - 1))
    rows = F.col("__rows")
    at = F.size(c) - rows
    usual = total(F.slice(v, 1, F.size(v) - 1)) / F.greatest(F.size(v) - 1, F.lit(1))
    d = d.withColumns({"__ratio": F.when((rows > 0) & (usual > 0), F.round(F.get(v, at) / usual + 3e-9, 2)).otherwise(0.0), "__before": F.coalesce(F.get(c, at - 1), F.get(c, at)), "__at": F.get(c, at)})
    inner = F.col("__before") < x if up else F.col("__before") > x
    near = F.exists(F.slice(l, at + 1, rows), lambda y: y <= x * 1.01) if up else F.exists(F.slice(h, at + 1, rows), lambda y: y >= x * 0.99)
    far = last(c) > x * 1.02 if up else last(c) < x * 0.98
    wick = (last(h) > x) & (x > last(c)) if up else (last(l) < x) & (x < last(c))
    d = d.withColumn("__again", (rows >= 3) & near)
    points = lambda cond, p: F.when(cond, p).otherwise(0)
    strength = F.least(F.lit(30), rows * 10) + points(beyond(F.col("__at")) & inner, 20) + points(F.col("__ratio") >= surge, 20) + points(F.col("__again"), 15) + points(far, 15)
    kind = F.when(rows == 0, F.when(wick, "wick_only").otherwise("none")).when(F.col("__again"), "with_retest").when(rows >= firm, "clean").otherwise("fresh")
    made = F.struct(rows.alias("rows"), F.col("__ratio").alias("volume_ratio"), F.when(rows == 0, points(wick, 10)).otherwise(F.least(F.lit(100), strength)).cast("int").alias("strength"), (rows >= firm).alias("confirmed"), kind.alias("kind"))
    d = d.withColumn(into, F.when(x.isNotNull() & (F.col("k") >= 5), made))
    return d.drop("__h", "__l", "__c", "__v", "__rows", "__ratio", "__before", "__at", "__again")


def twin_turns(d: DataFrame, into: str, bottom: bool, apart: int = 10, unlike: float = 0.03) -> DataFrame:
    """`d` with `into`: struct of the extreme and the neckline of the first two alike turning points of a frame, or null.

    A turning point is the lowest (highest) of 5 rows on each side. Of all pairs at least `apart` rows from one another and at most
    `unlike` in price, the earliest counts whose neckline, the extreme between them, and the last close lie beyond it.
    """
    y, other, c = F.col("l" if bottom else "h"), F.col("h" if bottom else "l"), last(F.col("c"))
    least, most = (F.least, F.array_max) if bottom else (F.greatest, F.array_min)
    own = F.array_min if bottom else F.array_max
    inside = F.when(F.col("k") > 2 * SIDE, F.sequence(F.lit(SIDE), F.col("k") - SIDE - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("__turns", F.filter(inside, lambda i: F.get(y, i) == own(F.slice(y, i - SIDE + 1, 2 * SIDE + 1))))
    turns = F.col("__turns")

    def pair(i, j):
        a, b = F.get(y, i), F.get(y, j)
        return F.struct(least(a, b).alias("extreme"), most(F.slice(other, i + 1, j - i + 1)).alias("neckline"), (F.abs(a - b) / least(a, b)).alias("unlike"))

    pairs = F.flatten(F.transform(turns, lambda i: F.transform(F.filter(turns, lambda j: j - i >= apart), lambda j: pair(i, j))))
    good = (lambda p: (p["unlike"] <= unlike) & (c > p["extreme"]) & (p["neckline"] > p["extreme"])) if bottom else (lambda p: (p["unlike"] <= unlike) & (c < p["extreme"]) & (p["neckline"] < p["extreme"]))
    return d.withColumn(into, F.get(F.filter(pairs, good), F.lit(0))).drop("__turns")


def chart_patterns(bars: DataFrame, pole: float = 15.0, flag: float = 8.0, box: float = 0.15, box_slope: float = 0.001, depth: float = 0.1, rim: float = 0.05, tilt: float = 0.001) -> DataFrame:
    """(symbol, trade_date, patterns, score): the chart patterns that a bar's last rows (60 at most) show, and their points within -40 to 40.

    A pattern is a struct of name, direction, confidence, level (the line or neckline), target and strength of the break. Triangles: lines through
    highs and through lows converge. Box: a narrow range without slope. Flags: a pole in the first half, a narrow drift against it in the second. Cup: a
    trough between level rims, then a handle. Rounding: a parabola fits twice as well as the mean. Twins: two alike lows (highs) with a
    neckline. Fewer than 25 rows show nothing. `pole` and `flag` are percents; the others are shares of the price.
    """
    d = framed(bars)
    c, k = F.col("c"), F.col("k")
    d = d.withColumns({"hs": digits(slope(F.col("h"))), "ls": digits(slope(F.col("l"))), "cs": digits(slope(c)), "m": mean(c), "hm": mean(F.col("h")), "lm": mean(F.col("l"))})
    reach = (k - 1) / 2
    d = d.withColumns({"top": digits(F.col("hm") + F.col("hs") * reach, 6), "floor": digits(F.col("lm") + F.col("ls") * reach, 6), "now": last(c)})
    hs, ls, now = F.col("hs"), F.col("ls"), F.col("now")
    tri = F.when(k < 30, None).when((hs < 0) & (ls > 0), "symmetric").when((hs < -tilt) & (F.abs(ls) < F.abs(hs) * 0.3), "descending").when((ls > tilt) & (F.abs(hs) < F.abs(ls) * 0.3), "ascending")
    # A parabola over evenly spaced places: its curvature is the share of z, the squares of the places less their mean.
    square = (k * k - 1) / 12
    z = lambda x: x * x - square
    x2, z2 = square, (k * k - 1) * (k * k - 4) / 180.0  # means of the squares of the places and of z
    d = d.withColumns({"tri": tri, "bend": weighed(c, z) / F.nullif(k * z2, F.lit(0.0))})
    spread = mean(F.transform(c, lambda y: (y - F.col("m")) * (y - F.col("m"))))
    exact = weighed(c, lambda x: x) / F.nullif(k * (k * k - 1.0) / 12, F.lit(0.0))
    d = d.withColumns({"spread": spread, "rest": F.greatest(F.lit(0.0), spread - exact * exact * x2 - F.col("bend") * F.col("bend") * z2)})
    d = d.withColumn("fit", digits(1 - F.sqrt("rest") / (F.sqrt("spread") + 1e-8)))
    d = twin_turns(twin_turns(d, "w", True), "t", False).withColumns({"w_line": F.col("w.neckline"), "t_line": F.col("t.neckline")})
    d = broken(broken(d, "top", "up", True), "floor", "down", False)
    d = broken(broken(d, "w_line", "w_broken", True), "t_line", "t_broken", False)

    over, under = F.col("up.confirmed") & (now > F.col("top")), F.col("down.confirmed") & (now < F.col("floor"))

    def pattern(cond, name, direction, confidence, points, level=None, target=None, strength=None):
        none = F.lit(None)
        made = F.struct(F.lit(name).alias("name"), direction.alias("direction"), confidence.cast("int").alias("confidence"), (none if level is None else level).cast("double").alias("level"), (none if target is None else target).cast("double").alias("target"), (none if strength is None else strength).cast("int").alias("strength"), points.cast("int").alias("points"))
        return F.when(cond, made)

    say = F.lit
    broke = F.when(now > F.col("top"), F.col("up.strength")).when(now < F.col("floor"), F.col("down.strength"))
    line = F.when(now > F.col("top"), F.col("top")).when(now < F.col("floor"), F.col("floor"))
    half = F.floor(k / 2).cast("int")
    late = lambda a: F.slice(a, half + 1, k - half)
    upper, lower = F.array_max(F.slice(F.col("h"), k - half + 1, half)), F.array_min(F.slice(F.col("l"), k - half + 1, half))
    d = d.withColumns({"pos": F.when(upper > lower, digits((now - lower) / (upper - lower))).otherwise(0.5), "range": digits((F.array_max("h") - F.array_min("l")) / F.col("m")), "rise": digits(100 * (F.get(c, half) / F.get(c, F.lit(0)) - 1)), "late": digits(slope(late(c))), "narrow": digits(100 * (F.array_max(late(F.col("h"))) - F.array_min(late(F.col("l")))) / mean(late(c)))})
    third, handle = F.floor(k / 3).cast("int"), F.slice(c, k - F.floor(k / 10).cast("int") + 1, F.floor(k / 10).cast("int"))
    d = d.withColumns({"trough": F.array_min(F.slice(c, third + 1, third)), "handle": F.array_max(handle)})
    first, pos, rise, bend, fit = F.get(c, F.lit(0)), F.col("pos"), F.col("rise"), F.col("bend"), F.col("fit")
    cup = (k >= 40) & (first > F.col("trough")) & (now > F.col("trough")) & (now > first * (1 - rim)) & (F.col("trough") < first * (1 - depth)) & (now < F.col("handle"))
    sided = lambda low, high, other: F.when(low, "bullish").when(high, "bearish").otherwise(other)
    w, t_ = F.col("w"), F.col("t")
    round_ = F.floor(60 + fit * 15)
    made = [
        pattern(F.col("tri") == "symmetric", "symmetric_triangle", sided(over, under, "neutral"), F.when(over | under, 80).otherwise(65), F.when(over, 18).when(under, -18).otherwise(0), line, None, broke),
        pattern(F.col("tri") == "descending", "descending_triangle", sided(over, say(True), "neutral"), F.when(under, 82).when(over, 78).otherwise(68), F.when(under, -22).when(over, 8).otherwise(-12), line, None, broke),
        pattern(F.col("tri") == "ascending", "ascending_triangle", say("bullish"), F.when(over, 85).otherwise(70), F.when(over, 25).otherwise(15), line, None, broke),
        pattern((k >= 30) & (F.col("range") < box) & (F.abs("cs") < F.col("m") * box_slope), "box", sided(pos < 0.3, pos > 0.7, "neutral"), say(72), F.when(pos < 0.3, 10).when(pos > 0.7, -10).otherwise(0)),
        pattern((k >= 30) & (rise > pole) & (F.col("narrow") < flag) & (F.col("late") <= 0), "bull_flag", say("bullish"), say(71), say(14)),
        pattern((k >= 30) & (rise < -pole) & (F.col("narrow") < flag) & (F.col("late") >= 0), "bear_flag", say("bearish"), say(71), say(-14)),
        pattern(cup, "cup_and_handle", say("bullish"), say(75), say(18), F.col("trough")),
        pattern((k >= 40) & (bend > 0) & (fit > 0.5) & (now > F.col("m")), "rounding_bottom", say("bullish"), round_, say(15)),
        pattern((k >= 40) & (bend < 0) & (fit > 0.5) & (now < F.col("m")), "rounding_top", say("bearish"), round_, say(-15)),
        pattern((k >= 25) & w.isNotNull(), "double_bottom", say("bullish"), F.when(F.col("w_broken.confirmed"), 85).otherwise(75), F.when(F.col("w_broken.confirmed"), 20).when(now > F.col("w_line") * 0.97, 8).otherwise(0), F.col("w_line"), 2 * F.col("w_line") - w["extreme"], F.col("w_broken.strength")),
        pattern((k >= 25) & t_.isNotNull(), "double_top", say("bearish"), F.when(F.col("t_broken.confirmed"), 85).otherwise(75), F.when(F.col("t_broken.confirmed"), -20).when(now < F.col("t_line") * 1.03, -8).otherwise(0), F.col("t_line"), 2 * F.col("t_line") - t_["extreme"], F.col("t_broken.strength")),
    ]
    d = d.withColumn("patterns", F.filter(F.array(*made), lambda p: p.isNotNull()))
    points = F.aggregate(F.col("patterns"), F.lit(0), lambda s, p: s + p["points"])
    shown = F.transform("patterns", lambda p: p.dropFields("points"))
    return d.select("symbol", "trade_date", shown.alias("patterns"), F.greatest(F.lit(-40), F.least(F.lit(40), points)).alias("score"))


# Divergences between turning points ----------------------------------------------------------------------


def pivot_inputs() -> Stages:
    """Bars with `dif` (means of 12 and 26 rows, from the first row on) and `rsi` (14 rows, seeded by their plain mean; null before)."""
    moves = {"up": "(CASE WHEN close > pc THEN close - pc ELSE 0.0 END)", "down": "(CASE WHEN close < pc THEN pc - close ELSE 0.0 END)"}
    seeds = {f"m{k}": f"avg({k}) {over(back(14))}" for k in ("up", "down")}
    means = [a | b for a, b in zip(recursive(14, su=("up", A14, "mup"), sdn=("down", A14, "mdown")), recursive(e12=("close", A12), e26=("close", A26)))]
    out = {"dif": "e12 - e26", "rsi": "(CASE WHEN i < 14 THEN NULL WHEN sdn > 0 THEN 100 - 100 / (1 + su / sdn) ELSE 100 - 100 / 101.0 END)"}
    return Stages("bars", (PREV | ROW, moves, seeds, *means, out), ("i", "high", "low", "dif", "rsi"))


def last_two_turns(d: DataFrame, x: str, into: str, side: int, w: int, lookback: int) -> DataFrame:
    """`d` with array `into`: the last two rows, as structs of i, x, dif and rsi, that no row up to `w` before and `w` after exceeds, as known at each row.

    A turn is certain `w` rows later; among the last `w` rows one counts if no row after it so far exceeds it. Certain turns come from windows over turns
    only (the last one and, with it, the one before), so no row holds more than `w` bars. side is 1 for tops, -1 for bottoms.
    """
    t = by_time()
    y = F.col(x) * side
    left = F.when(F.count(x).over(t.rowsBetween(-w, -1)) == w, F.max(y).over(t.rowsBetween(-w, -1)))
    right = F.when(F.count(x).over(t.rowsBetween(1, w)) == w, F.max(y).over(t.rowsBetween(1, w)))
    turn = F.struct("i", F.col(x).alias("x"), "dif", "rsi")
    d = d.withColumns({"__turn": turn, "__left": left, "__right": right}).withColumn("__sure", F.when((y >= F.col("__left")) & (y >= F.col("__right")), F.col("__turn")))
    d = d.withColumn("__before", F.last("__sure", ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__pair", F.when(F.col("__sure").isNotNull(), F.array("__before", "__sure")))
    known = F.last("__pair", ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, -w))
    recent = F.collect_list(F.struct(F.col("__turn").alias("t"), y.alias("y"), F.col("__left").alias("l"))).over(t.rowsBetween(1 - w, 0))
    d = d.withColumns({"__known": known, "__recent": recent})
    rest = lambda j: F.slice("__recent", j + 2, F.greatest(F.size("__recent") - j - 1, F.lit(0)))
    maybe = F.transform(F.filter("__recent", lambda r, j: r["l"].isNotNull() & (r["y"] >= r["l"]) & ~F.exists(rest(j), lambda s: s["y"] > r["y"])), lambda r: r["t"])
    every = F.filter(F.concat(F.coalesce("__known", F.array().cast("array<struct<i: double, x: double, dif: double, rsi: double>>")), maybe), lambda s: s.isNotNull() & (F.col("i") - s["i"] < lookback - w))
    return d.withColumn(into, F.slice(every, F.greatest(F.size(every) - 1, F.lit(1)), 2)).drop("__turn", "__left", "__right", "__sure", "__before", "__pair", "__known", "__recent")


def divergences(d: DataFrame, w: int = 5, lookback: int = 200, least: int = 40) -> DataFrame:
    """(symbol, trade_date, macd_top, macd_bottom, rsi_top, rsi_bottom, macd_magnitude, rsi_magnitude, bars_ago, score) of `pivot_inputs`.

    A top diverges if the last of two tops is higher while dif (rsi, by over 2) is lower there; bottoms the other way. Magnitudes are the change of dif by its larger size and of rsi by
    25, 1 at most. The score has 15 to 30 points for dif, 12 to 25 for rsi and 15 for both, bottoms minus tops, within -100 to 100. Nothing in a symbol's first `least` rows.
    """
    d = last_two_turns(last_two_turns(d, "high", "tops", 1, w, lookback), "low", "bottoms", -1, w, lookback)
    found, ago = {}, []
    for name, side in (("top", 1), ("bottom", -1)):
        a, b = F.get(f"{name}s", F.lit(0)), F.get(f"{name}s", F.lit(1))
        further = (F.col("i") >= least - 1) & ((b["x"] - a["x"]) * side > 0)
        by_dif = F.coalesce(further & ((a["dif"] - b["dif"]) * side > 0), F.lit(False))
        by_rsi = F.coalesce(further & ((a["rsi"] - b["rsi"]) * side > 2), F.lit(False))
        size = F.greatest(F.abs(a["dif"]), F.abs(b["dif"]), F.lit(1e-6))
        found |= {f"macd_{name}": by_dif, f"rsi_{name}": by_rsi, f"__m_{name}": F.when(by_dif, F.least(F.lit(1.0), F.round(F.abs(a["dif"] - b["dif"]) / size, 9))), f"__r_{name}": F.when(by_rsi, F.least(F.lit(1.0), F.round(F.abs(a["rsi"] - b["rsi"]) / 25, 9))), f"__ago_{name}": F.when(by_dif | by_rsi, F.col("i") - b["i"])}
    d = d.withColumns(found)
    points = lambda name: F.coalesce(15 + F.floor(F.col(f"__m_{name}") * 15), F.lit(0)) + F.coalesce(12 + F.floor(F.col(f"__r_{name}") * 13), F.lit(0)) + F.when(F.col(f"macd_{name}") & F.col(f"rsi_{name}"), 15).otherwise(0)
    larger = lambda k: F.coalesce(F.greatest(f"__{k}_top", f"__{k}_bottom"), F.lit(0.0))
    total = F.greatest(F.lit(-100), F.least(F.lit(100), points("bottom") - points("top"))).cast("int")
    return d.select("symbol", "trade_date", "macd_top", "macd_bottom", "rsi_top", "rsi_bottom", larger("m").alias("macd_magnitude"), larger("r").alias("rsi_magnitude"), F.least("__ago_top", "__ago_bottom").cast("int").alias("bars_ago"), total.alias("score"))
