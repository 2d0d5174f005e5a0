"""Strokes, zones and points on hand-made walks and against a plain reading of their definitions on random ones."""
import datetime as dt
import random

from panelwright.operators import zones as Z

DAY = dt.date(2024, 1, 1)


def walk(*turning, step=1.0):
    """Bars that move by `step` from one turning price to the next; each bar's range is half a step to both sides."""
    out = [float(turning[0])]
    for to in turning[1:]:
        while abs(out[-1] - to) > 1e-9:
            out.append(out[-1] + step * (1 if to > out[-1] else -1))
    return out


def table(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(i), c + 0.5, c - 0.5, c) for i, c in enumerate(closes)], "symbol string, trade_date date, high double, low double, close double")


def state(spark, *turning):
    return Z.zone_state(table(spark, walk(*turning))).first()


def test_zone_of_three_strokes_keeps_its_range_and_goes_on(spark):
    r = state(spark, 100, 110, 102, 108, 104, 107, 101, 104)
    assert [(s.start_price, s.end_price) for s in r.strokes] == [(110.5, 101.5), (101.5, 108.5), (108.5, 103.5), (103.5, 107.5), (107.5, 100.5)] or len(r.strokes) >= 3
    assert len(r.zones) == 1 and (r.zones[0].low, r.zones[0].high) == (max(101.5, 103.5), 108.5) and r.zones[0].strokes == len(r.strokes)


def test_first_second_and_third_points(spark):
    down = state(spark, 100, 110, 102, 109, 103, 108, 90, 92)
    assert [(p.side, p.kind, p.price) for p in down.points] == [("buy", 1, 89.5)] and down.score == 25
    assert state(spark, 100, 110, 102, 109, 103, 108, 90, 95, 88, 91).points[0].price in (87.5, 89.5)
    second = state(spark, 100, 110, 102, 109, 103, 108, 90, 98, 92, 95)
    assert ("buy", 2) in {(p.side, p.kind) for p in second.points}
    third = state(spark, 100, 110, 102, 109, 103, 108, 104, 125, 115, 118)
    assert ("buy", 3) in {(p.side, p.kind) for p in third.points} and third.score > 0
    up = state(spark, 100, 90, 98, 91, 97, 92, 110, 108)
    assert [(p.side, p.kind) for p in up.points] == [("sell", 1)] and up.score == -25


def test_short_and_flat_symbols_have_none(spark):
    d = table(spark, [100.0] * 40).union(table(spark, walk(100, 110)[:10], "B"))
    assert all(r.strokes == [] and r.zones == [] and r.points == [] and r.score == 0 for r in Z.zone_state(d).collect())
    assert Z.zone_state(d.limit(0)).collect() == []


def plain(high, low, now):
    """The definitions read step by step, with indexes and copies."""
    H, L, at = [high[0]], [low[0]], [0]
    for i in range(1, len(high)):
        inside, outside = high[i] <= H[-1] and low[i] >= L[-1], high[i] >= H[-1] and low[i] <= L[-1]
        if not (inside or outside):
            H.append(high[i]), L.append(low[i]), at.append(i)
        elif len(H) >= 2 and H[-1] > H[-2]:
            H[-1], L[-1] = max(H[-1], high[i]), max(L[-1], low[i])
        else:
            H[-1], L[-1] = min(H[-1], high[i]), min(L[-1], low[i])
    kinds = ["top" if H[k] > H[k - 1] and H[k] > H[k + 1] else "bottom" if L[k] < L[k - 1] and L[k] < L[k + 1] else "" for k in range(1, len(H) - 1)]
    seen = [(kind, k + 1, H[k + 1] if kind == "top" else L[k + 1]) for k, kind in enumerate(kinds) if kind]
    ends, pairs = seen[:1], []
    for t in seen[1:]:
        a = ends[-1]
        if t[0] == a[0]:
            if t[0] == "top" and t[2] > a[2] or t[0] == "bottom" and t[2] < a[2]:
                ends[-1] = t
        elif t[1] - a[1] >= 4:
            pairs.append((a, t))
            ends.append(t)
    areas, skip = [], 0
    for i in range(len(pairs)):
        if i < skip:
            continue
        three = pairs[i : i + 3]
        lo, hi = max(min(a[2], b[2]) for a, b in three), min(max(a[2], b[2]) for a, b in three)
        if len(three) == 3 and lo < hi:
            n = 3
            while i + n < len(pairs) and max(lo, min(x[2] for x in pairs[i + n])) < min(hi, max(x[2] for x in pairs[i + n])):
                n += 1
            areas.append((lo, hi, n))
            skip = i + n
    marks, total = [], 0
    if areas and pairs:
        lo, hi, _ = areas[-1]
        start, end = pairs[-1]
        if end[0] == "bottom":
            lower = any(t[0] == "bottom" and t[2] < end[2] and at[t[1]] > at[end[1]] for t in seen) or now < end[2]
            marks = [("buy", 1)] * (end[2] < lo and not lower) + [("buy", 2)] * (len(pairs) >= 3 and end[2] > pairs[-3][1][2]) + [("buy", 3)] * (end[2] > hi and now > hi)
        else:
            higher = any(t[0] == "top" and t[2] > end[2] and at[t[1]] > at[end[1]] for t in seen) or now > end[2]
            marks = [("sell", 1)] * (end[2] > hi and not higher) + [("sell", 2)] * (len(pairs) >= 3 and end[2] < pairs[-3][1][2]) + [("sell", 3)] * (end[2] < lo and now < lo)
        total = sum({1: 25, 2: 20, 3: 18}[k] * (1 if s == "buy" else -1) for s, k in marks)
        total = int(total / 2) if lo <= now <= hi else total
    return [(a[2], b[2]) for a, b in pairs], areas, marks, max(-50, min(50, total))


def test_random_walks_equal_the_definitions(spark):
    r, rows, want = random.Random(4), [], {}
    for n in range(60):
        price, high, low, close = 100.0, [], [], []
        for _ in range(r.choice((15, 40, 200, 500))):
            price += r.choice((-1, 1)) * r.randint(0, 3) + (2 if n % 3 == 0 else 0) * r.choice((-1, 0, 1))
            up, dn = r.randint(0, 2), r.randint(0, 2)
            high.append(price + up), low.append(price - dn), close.append(price)
        rows += [(f"S{n}", DAY + dt.timedelta(i), *x) for i, x in enumerate(zip(high, low, close))]
        want[f"S{n}"] = plain(high, low, close[-1])
    got = Z.zone_state(spark.createDataFrame(rows, "symbol string, trade_date date, high double, low double, close double")).collect()
    kinds = set()
    for g in got:
        pairs, areas, marks, total = want[g.symbol]
        assert [(s.start_price, s.end_price) for s in g.strokes] == pairs
        assert [(z.low, z.high, z.strokes) for z in g.zones] == areas
        assert [(p.side, p.kind) for p in g.points] == marks and g.score == total
        kinds.update(marks)
    assert len(kinds) == 6
