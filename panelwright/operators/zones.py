"""Strokes between turning points, the zones in which three and more strokes overlap, and the points where price leaves and comes back.

Each step depends on what the ones before it decided, so a symbol's bars are folded in order, one group a symbol; results are a few small rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of each kind of entry and exit; a price inside the last zone halves their sum.
POINTS = {1: 25, 2: 20, 3: 18}
GAP = 4
STATE = "symbol string, trade_date date, strokes array<struct<direction: int, start: date, end: date, start_price: double, end_price: double>>, zones array<struct<low: double, high: double, start: date, end: date, strokes: int>>, points array<struct<side: string, kind: int, price: double, at: date>>, score int"


def merged(high: list[float], low: list[float]) -> list[tuple[float, float, int]]:
    """(high, low, first row) of bars, those that contain one another made one: the higher of both ends while highs rise, the lower otherwise."""
    out: list[tuple[float, float, int]] = []
    for i, (h, l) in enumerate(zip(high, low)):
        if out and (h - out[-1][0]) * (l - out[-1][1]) <= 0:
            pick = max if len(out) > 1 and out[-1][0] > out[-2][0] else min
            out[-1] = pick(out[-1][0], h), pick(out[-1][1], l), out[-1][2]
        else:
            out.append((h, l, i))
    return out


def turns(bars: list[tuple[float, float, int]]) -> list[tuple[int, int, int, float]]:
    """(1 for a top or -1 for a bottom, place among the merged bars, row, price): a high above both neighbours', or else a low below theirs."""
    out = []
    for k in range(1, len(bars) - 1):
        (h0, l0, _), (h, l, i), (h1, l1, _) = bars[k - 1 : k + 2]
        if h > max(h0, h1):
            out.append((1, k, i, h))
        elif l < min(l0, l1):
            out.append((-1, k, i, l))
    return out


def strokes(found: list[tuple[int, int, int, float]]) -> list[tuple]:
    """(turn, turn) pairs of opposite kind at least GAP merged bars apart; of like turns in a row the more extreme one counts."""
    out, last = [], found[0] if found else None
    for t in found[1:]:
        if t[0] == last[0]:
            last = t if (t[3] - last[3]) * t[0] > 0 else last
        elif t[1] - last[1] >= GAP:
            out.append((last, t))
            last = t
    return out


def zones(found: list[tuple]) -> list[tuple[float, float, int, int]]:
    """(low, high, first stroke, strokes): where three strokes in a row overlap, carried on over all that overlap it as well. The zone keeps the range of its first three."""
    span = [tuple(sorted((a[3], b[3]))) for a, b in found]
    out, i = [], 0
    while i + 3 <= len(span):
        low, high = max(s[0] for s in span[i : i + 3]), min(s[1] for s in span[i : i + 3])
        if high <= low:
            i += 1
            continue
        end = i + 3
        while end < len(span) and min(high, span[end][1]) > max(low, span[end][0]):
            end += 1
        out.append((low, high, i, end - i))
        i = end
    return out


def points(found: list[tuple], areas: list[tuple], turned: list[tuple], now: float) -> list[tuple[str, int, float, int]]:
    """(side, kind, price, row) of the last stroke. First kind: it ends beyond the zone and nothing has gone further since. Second: it stops short of
    the end of the stroke of its kind before it. Third: it comes back towards the zone without reaching it, and price stays there."""
    if not areas:
        return []
    (low, high, *_), (_, end) = areas[-1], found[-1]
    kind, _, row, price = end
    side = "sell" if kind > 0 else "buy"
    beyond = (lambda x: x > high) if kind > 0 else (lambda x: x < low)
    short_of = (lambda x: x < low) if kind > 0 else (lambda x: x > high)
    further = any(t[0] == kind and (t[3] - price) * kind > 0 and t[2] > row for t in turned) or (now - price) * kind > 0
    out = [(side, 1, price, row)] if beyond(price) and not further else []
    if len(found) >= 3 and (found[-3][1][3] - price) * kind > 0:
        out.append((side, 2, price, row))
    if short_of(price) and short_of(now):
        out.append((side, 3, price, row))
    return out


def score(found: list[tuple], areas: list[tuple], now: float) -> int:
    total = sum(POINTS[kind] * (1 if side == "buy" else -1) for side, kind, *_ in found)
    if areas and areas[-1][0] <= now <= areas[-1][1]:
        total = int(total * 0.5)
    return max(-50, min(50, total))


def zone_state(bars: DataFrame, least: int = 15) -> DataFrame:
    """STATE of each symbol at its last bar; fewer than `least` bars have no strokes. Bars with a null price are left out."""
    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values("trade_date")
        day, now = pdf["trade_date"].tolist(), pdf["close"].iloc[-1]
        turned = turns(merged(pdf["high"].tolist(), pdf["low"].tolist())) if len(day) >= least else []
        found = strokes(turned)
        areas = zones(found)
        marked = points(found, areas, turned, now)
        return pd.DataFrame({
            "symbol": [pdf["symbol"].iloc[0]], "trade_date": [day[-1]], "score": [score(marked, areas, now)],
            "strokes": [[{"direction": b[0], "start": day[a[2]], "end": day[b[2]], "start_price": a[3], "end_price": b[3]} for a, b in found]],
            "zones": [[{"low": low, "high": high, "start": day[found[i][0][2]], "end": day[found[i + n - 1][1][2]], "strokes": n} for low, high, i, n in areas]],
            "points": [[{"side": s, "kind": k, "price": p, "at": day[row]} for s, k, p, row in marked]],
        })[["symbol", "trade_date", "strokes", "zones", "points", "score"]]

    d = bars.select("symbol", "trade_date", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close")))
    return d.na.drop().groupBy("symbol").applyInPandas(fold, STATE)
