"""Thirty-five candle patterns against a plain reading of their definitions on random bars; each is met at least once."""
import datetime as dt
import random

from panelwright.operators import candles

DAY = dt.date(2024, 1, 1)
TWINS = {  # a bullish pattern and its mirror image
    "hammer": "shooting_star", "inverted_hammer": "hanging_man", "doji": "doji", "long_rise": "long_fall", "bullish_engulfing": "bearish_engulfing", "bullish_harami": "bearish_harami", "piercing": "dark_cloud", "flat_bottom": "flat_top", "bullish_counter": "bearish_counter",
    "gap_up_rise": "gap_down_fall", "morning_star": "evening_star", "three_soldiers": "three_crows", "fall_between_rises": "rise_between_falls", "three_inside_up": "three_inside_down", "three_outside_up": "three_outside_down", "small_double_bottom": "small_double_top", "small_head_bottom": "small_head_top", "rising_three": "falling_three",
}


def plain(bars):
    """Names of the patterns at the last of up to five bars (open, high, low, close), oldest first."""
    n, out = len(bars), set()
    O, H, L, C = map(list, zip(*bars))
    body = [c - o for o, c in zip(O, C)]
    rng = [(h - l) or 1e-8 for h, l in zip(H, L)]
    mid = (n - 1) / 2
    slope = round(sum((i - mid) * c for i, c in enumerate(C)), 9) if n >= 3 else 0
    for up in (True, False):  # the second time everything upside down
        name = lambda good: good if up else TWINS[good]  # noqa: E731, B023
        if not up:
            O, H, L, C, body, slope = [-x for x in O], [-x for x in L], [-x for x in H], [-x for x in C], [-x for x in body], -slope
        a = [abs(x) for x in body]
        top, tail, r = H[-1] - max(O[-1], C[-1]), min(O[-1], C[-1]) - L[-1], rng[-1]
        if tail >= 2 * max(a[-1], 0.04 * r) and top < 0.15 * r and slope < 0:
            out.add(name("hammer"))
        if top >= 2 * max(a[-1], 0.04 * r) and tail < 0.15 * r and slope < 0:
            out.add(name("inverted_hammer"))
        if a[-1] < 0.1 * r:
            out.add("doji")
        if body[-1] > 0.6 * r:
            out.add(name("long_rise"))
        engulfs = lambda i: body[i - 1] < -0.25 * rng[i - 1] and body[i] > 0 and O[i] <= C[i - 1] and C[i] >= O[i - 1]  # noqa: E731, B023
        inside = lambda i: body[i - 1] < -0.35 * rng[i - 1] and body[i] > 0 and O[i] > C[i - 1] and C[i] < O[i - 1] and a[i] < 0.55 * a[i - 1]  # noqa: E731, B023
        if n >= 2:
            half = (O[-2] + C[-2]) / 2
            for good, cond in (
                ("bullish_engulfing", engulfs(-1)), ("bullish_harami", inside(-1)), ("piercing", body[-2] < -0.3 * rng[-2] and body[-1] > 0 and O[-1] < L[-2] and C[-1] > half),
                ("flat_bottom", slope < 0 and abs(L[-1] - L[-2]) < 0.003 * abs(L[-2])), ("bullish_counter", body[-2] < 0 < body[-1] and O[-1] < L[-2] and abs(C[-1] - C[-2]) < 0.003 * abs(C[-2])), ("gap_up_rise", O[-1] > H[-2] and body[-1] > 0),
            ):
                if cond:
                    out.add(name(good))
        if n >= 3:
            for good, cond in (
                ("morning_star", body[-3] < -0.4 * rng[-3] and a[-2] < 0.3 * rng[-2] and body[-1] > 0.4 * r and C[-1] > (O[-3] + C[-3]) / 2), ("three_soldiers", all(body[i] > 0.3 * rng[i] for i in (-1, -2, -3)) and C[-3] < C[-2] < C[-1] and O[-3] < O[-2] < O[-1]),
                ("fall_between_rises", body[-3] > 0 > body[-2] and body[-1] > 0 and C[-1] > C[-3]), ("three_inside_up", inside(-2) and body[-1] > 0 and C[-1] > O[-3]), ("three_outside_up", engulfs(-2) and body[-1] > 0 and C[-1] > C[-2]),
            ):
                if cond:
                    out.add(name(good))
        if n >= 5:
            early, late, head, peak, neck = min(L[:2]), min(L[3:]), min(L[1:4]), max(H[1:4]), max(H[1], H[3])
            # Shares of a price have to be of the price itself, upside down or not.
            part = lambda x, share: x * (1 + share) if x > 0 else x * (1 - share)
            if abs(late - early) < 0.025 * abs(early) and peak > part(early, 0.025) and body[-1] > 0 and C[-1] > part(peak, -0.03):
                out.add(name("small_double_bottom"))
            if head < part(early, -0.015) and head < part(late, -0.015) and abs(early - late) < 0.04 * abs(early) and C[-1] > neck:
                out.add(name("small_head_bottom"))
            if body[0] > 0.5 * rng[0] and all(body[i] < 0 and a[i] < 0.4 * a[0] and L[i] >= L[0] and H[i] <= H[0] for i in (1, 2, 3)) and body[4] > 0.5 * rng[4] and C[4] > H[0]:
                out.add(name("rising_three"))
    return out


def test_random_bars_equal_the_definitions(spark):
    r, rows, series = random.Random(5), [], {}
    def bar(o, c):
        return o, max(o, c) + r.choice((0.0, 0.05, 0.4, 2.0)), min(o, c) - r.choice((0.0, 0.05, 0.4, 2.0)), c

    for k in range(60):
        price, own = 100.0, []
        for _ in range(r.choice((2, 4, 90, 90))):
            o = round(price + r.choice((0, 0, 0.3, -0.3, 2.1, -2.1)), 2)
            price = round(o + r.choice((0, 0.05, -0.05, 0.6, -0.6, 2.5, -2.5, 4, -4)), 2)
            own.append(tuple(round(x, 2) for x in bar(o, price)))
        series[f"S{k}"] = own
    three = [(100, 104.2, 99.8, 104), (103.5, 103.8, 102.5, 103), (103, 103.2, 102, 102.4), (102.5, 102.8, 101.6, 102), (102, 106.4, 101.9, 106)]
    series["three"], series["mirror"] = [tuple(map(float, x)) for x in three], [(200.0 - o, 200.0 - l, 200.0 - h, 200.0 - c) for o, h, l, c in three]
    head = [(100, 101, 99, 100.5), (100.5, 101, 99.2, 99.5), (99, 99.5, 95, 98), (98, 101, 97.9, 100.5), (100.5, 104, 99.3, 103.5)]
    series["head"], series["head top"] = [tuple(map(float, x)) for x in head], [(200.0 - o, 200.0 - l, 200.0 - h, 200.0 - c) for o, h, l, c in head]
    rows = [(s, DAY + dt.timedelta(i), *b) for s, own in series.items() for i, b in enumerate(own)]
    got = candles.candle_patterns(spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double")).collect()
    met, base = set(), {name: (way, sure) for name, way, sure, _ in candles.PATTERNS}
    for g in got:
        i, own = (g.trade_date - DAY).days, series[g.symbol]
        assert {p.name for p in g.patterns} == plain(own[max(0, i - 4) : i + 1]), (g.symbol, i, own[max(0, i - 4) : i + 1])
        closes = [b[3] for b in own[max(0, i - 19) : i + 1]]
        place = 100 * (closes[-1] - min(closes)) / (max(closes) - min(closes)) if max(closes) > min(closes) else 50
        assert abs(g.place - place) < 1e-9
        for p in g.patterns:
            way, sure = base[p.name]
            back = place < 30 if way == "bullish" else place > 70
            there = place > 70 if way == "bullish" else place < 30
            assert p.direction == way and p.confidence == (sure if way == "neutral" else max(30, min(95, sure + (8 if back else -10 if there else 0))))
        met |= {p.name for p in g.patterns}
    assert met == {name for name, *_ in candles.PATTERNS} and len(met) == 35
