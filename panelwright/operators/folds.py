"""Operators that fold a key's rows in order, where each row depends on what was decided before.

One group is one key's rows in time order; keys spread over tasks. All are `applyInPandas` grouped maps.
"""
from __future__ import annotations

from pyspark.sql import DataFrame


def adaptive_average(bars: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Kaufman's average: the gain of each row is its net move over its path of n rows."""
    def fold(pdf):
        import numpy as np

        pdf = pdf.sort_values("trade_date")
        c = pdf["close"].to_numpy()
        out = np.full(len(c), np.nan)
        if len(c) > n:
            out[n - 1] = c[n - 1]
            path = np.abs(np.diff(c))
            for i in range(n, len(c)):
                span = path[i - n : i].sum()
                gain = (abs(c[i] - c[i - n]) / span if span else 0.0) * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)
                out[i] = out[i - 1] + gain * gain * (c[i] - out[i - 1])
        return pdf.assign(kama=out, kama_dist=c / out - 1)[["symbol", "trade_date", "kama", "kama_dist"]]

    return bars.select("symbol", "trade_date", "close").groupBy("symbol").applyInPandas(fold, "symbol string, trade_date date, kama double, kama_dist double")


def parabolic_stop(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """Parabolic stop-and-reverse level and side."""
    def fold(pdf):
        pdf = pdf.sort_values("trade_date")
        high, low, close = (pdf[c].tolist() for c in ("high", "low", "close"))
        sar, side = [], []
        up, af = True, step
        level, best = (low[0], high[0]) if high else (0.0, 0.0)
        for i in range(len(high)):
            if i:
                level += af * (best - level)
                level = min(level, *low[max(0, i - 2) : i]) if up else max(level, *high[max(0, i - 2) : i])
                if low[i] < level if up else high[i] > level:
                    up, level, best, af = not up, best, low[i] if up else high[i], step
                elif high[i] > best if up else low[i] < best:
                    best, af = high[i] if up else low[i], min(most, af + step)
            sar.append(level)
            side.append(1 if close[i] > level else -1)
        return pdf.assign(sar=sar, sar_signal=side)[["symbol", "trade_date", "sar", "sar_signal"]]

    return bars.select("symbol", "trade_date", "high", "low", "close").groupBy("symbol").applyInPandas(fold, "symbol string, trade_date date, sar double, sar_signal int")


def next_phase(phase: int, days: int, place: float | None, slope: float | None) -> tuple[int, int]:
    """One step of the channel walk: 0 outside, 1 at the floor, 2 turning, 3 rising, 4 at the ceiling, 5 falling; phases 1, 2 and 4 time out."""
    if place is None or slope is None:
        return 0, 0
    if place <= 0.1:
        return (1, days + 1 if phase == 1 else 0)
    if place >= 0.9:
        return (4, days + 1 if phase == 4 else 0)
    if phase == 1:
        return (2, 0) if slope > 0 else (1, days + 1) if days < 10 else (0, 0)
    if phase == 2:
        return (3, 0) if place > 0.5 else (2, days + 1) if days < 15 else (0, 0)
    if phase == 4:
        return (5, 0) if slope < 0 else (4, days + 1) if days < 10 else (0, 0)
    if phase == 3:
        return (3, days + 1) if slope >= 0 or place > 0.5 else (0, 0)
    if phase == 5:
        return (5, days + 1) if slope <= 0 or place < 0.5 else (0, 0)
    return 0, days + 1


def channel_phases(features: DataFrame) -> DataFrame:
    """Phase and rows in it, from columns `place` (0 at the floor, 1 at the ceiling) and `slope`."""
    def fold(pdf):
        pdf = pdf.sort_values("trade_date")
        phase, days, out = 0, 0, []
        for place, slope in zip(pdf["place"], pdf["slope"]):
            phase, days = next_phase(phase, days, None if place != place else place, None if slope != slope else slope)
            out.append((phase, days))
        return pdf.assign(phase=[p for p, _ in out], days=[d for _, d in out])[["symbol", "trade_date", "phase", "days"]]

    return features.select("symbol", "trade_date", "place", "slope").groupBy("symbol").applyInPandas(fold, "symbol string, trade_date date, phase int, days int")


def strokes(bars: DataFrame, gap: int = 4) -> DataFrame:
    """Strokes between alternating tops and bottoms: bars contained in one another are merged in the direction
    of the move, fractals are the merged bars above (below) both neighbours, and of two like ones the more extreme stays."""
    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values("trade_date")
        merged: list[list] = []  # high, low, place
        up = True
        for i, (h, l) in enumerate(zip(pdf["high"], pdf["low"])):
            if merged and (h <= merged[-1][0] and l >= merged[-1][1] or h >= merged[-1][0] and l <= merged[-1][1]):
                pick = max if up else min
                merged[-1] = [pick(h, merged[-1][0]), pick(l, merged[-1][1]), i]
            else:
                if merged:
                    up = h > merged[-1][0]
                merged.append([h, l, i])
        ends: list[tuple[int, int, float]] = []  # kind, place, price
        for k in range(1, len(merged) - 1):
            a, b, c = merged[k - 1 : k + 2]
            kind = 1 if b[0] > a[0] and b[0] > c[0] else -1 if b[1] < a[1] and b[1] < c[1] else 0
            if not kind:
                continue
            price = b[0] if kind > 0 else b[1]
            if ends and ends[-1][0] == kind:
                if (price - ends[-1][2]) * kind > 0:
                    ends[-1] = (kind, b[2], price)
            elif not ends or b[2] - ends[-1][1] >= gap:
                ends.append((kind, b[2], price))
        date = pdf["trade_date"].tolist()
        rows = [(pdf["symbol"].iloc[0], date[a[1]], date[b[1]], a[2], b[2], b[0], b[1] - a[1]) for a, b in zip(ends, ends[1:])]
        return pd.DataFrame(rows, columns=["symbol", "start", "end", "start_price", "end_price", "direction", "bars"])

    return bars.select("symbol", "trade_date", "high", "low").groupBy("symbol").applyInPandas(fold, "symbol string, start date, end date, start_price double, end_price double, direction int, bars int")
