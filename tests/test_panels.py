"""Every registered panel query against its SQL on the smallest tables, and properties of the operators."""
import glob
import math
import os

import duckdb
import pytest

from panelwright import queries as panel
from panelwright.operators import panels as P
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


SOME = ("w02_macd", "w19_limit_runs", "w26_heikin_ashi", "l02_forward_labels", "ev06_validity", "rk02_date_quantiles", "jn06_as_of", "sr08_stretched", "d01_candles", "pb02_performance")


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, con, name):
    got = panel.QUERIES[name](spark, SF)
    want = con.execute(panel.ORACLE_SQL[name])
    cols = sorted(c[0] for c in want.description)
    assert cols == sorted(got.columns)
    at = [[c[0] for c in want.description].index(c) for c in cols]
    order = lambda rows: sorted(rows, key=str)
    assert order([tuple(plain(r[c]) for c in cols) for r in got.collect()]) == order([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


def bars(spark, n=40):
    rows = [("A", i, 100.0 + (i * 7) % 11, 102.0 + (i * 7) % 11, 99.0 + (i * 7) % 11, 101.0 + (i * 5) % 7) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, trade_date int, open double, high double, low double, close double")


def test_labels_look_only_forward_and_end_null(spark):
    d = {r.trade_date: r for r in P.forward(bars(spark), (5,)).collect()}
    assert all(d[i].r_5 is None for i in range(35, 40)) and d[34].r_5 is not None
    assert d[0].r_5 == pytest.approx(100 * (d[5].close / d[1].open - 1))
    assert d[0].max_gain_5 == pytest.approx(100 * (max(d[i].high for i in range(1, 6)) / d[1].open - 1))


def test_features_have_no_look_ahead(spark):
    from panelwright.operators.features import moving_averages

    key = lambda d: {r.trade_date: tuple(r) for r in moving_averages().apply(d).collect()}
    whole, cut = key(bars(spark)), key(bars(spark).where("trade_date < 25"))
    assert all(whole[k] == cut[k] for k in cut)


def test_rank_bins_are_even_and_skip_nulls(spark):
    d = spark.createDataFrame([("A", i, float(i % 9) if i % 10 else None) for i in range(100)], "symbol string, trade_date int, x double")
    got = [r.q for r in d.select(P.rank_bins("x", []).alias("q")).collect()]
    counts = [got.count(k) for k in range(1, 6)]
    assert got.count(None) == 10 and sum(counts) == 90 and max(counts) - min(counts) <= 2


def test_as_of_takes_the_latest_row(spark):
    left = spark.sql("SELECT 'A' AS symbol, DATE '2024-01-05' AS trade_date UNION ALL SELECT 'A', DATE '2023-01-01' UNION ALL SELECT 'B', DATE '2024-01-05'")
    right = spark.sql("SELECT 'A' AS symbol, DATE '2024-01-01' AS trade_date, 1.0D AS v UNION ALL SELECT 'A', DATE '2024-01-05', 2.0D UNION ALL SELECT 'A', DATE '2024-01-06', 3.0D")
    got = {(r.symbol, str(r.trade_date)): r.v for r in P.as_of(left, right, ["v"]).collect()}
    assert got == {("A", "2024-01-05"): 2.0, ("A", "2023-01-01"): None, ("B", "2024-01-05"): None}


def test_budget_never_exceeds(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("d", i, 0.2) for i in range(9)], "day string, k int, size double")
    got = P.budget_fill(d, "size", 0.5, ["day"], [F.col("k")]).orderBy("k").collect()
    assert [round(r.position, 6) for r in got] == [0.2, 0.2, 0.1]


def test_empty_tables(spark):
    empty = bars(spark).where("false")
    assert P.forward(empty).count() == 0 and P.top_n(empty, ["trade_date"], "close", 3).count() == 0


def test_take_profit_and_nav(spark):
    d = P.take_profit(bars(spark), (1.0,), 5).collect()
    assert all(r.outcome == 1.0 for r in d if r.hit)
    n = P.nav(spark.createDataFrame([("a", i, 10.0 if i % 2 else -10.0) for i in range(4)], "book string, trade_date int, r double"), ["book"], "r").orderBy("trade_date").collect()
    assert n[-1].nav == pytest.approx(0.9 * 1.1 * 0.9 * 1.1) and min(r.drawdown for r in n) == pytest.approx(0.9 * 1.1 * 0.9 - 1)


def test_recursive_means_of_long_keys_equal_a_loop(spark):
    import random

    from panelwright.operators import features as W

    r, close = random.Random(3), [100.0]
    for _ in range(19_999):
        close.append(max(1.0, close[-1] + r.uniform(-1, 1)))
    d = spark.createDataFrame([("A", i, c, c + 1, c - 1, c) for i, c in enumerate(close)], "symbol string, trade_date int, open double, high double, low double, close double").selectExpr("*", "1.0D AS vol")

    def means(xs, a, start=0, seed=None):
        out = [None] * start
        for i, x in enumerate(xs[start:]):
            out.append((x if seed is None else seed) if i == 0 else (1 - a) * out[-1] + a * x)
        return out

    got = sorted(W.macd().apply(d).collect(), key=lambda x: x.trade_date)
    dif = [a - b for a, b in zip(means(close, W.A12), means(close, W.A26))]
    dea = means(dif, W.A9)
    ta = [None] * 25 + [a - b for a, b in zip(means(close, W.A12, 25, sum(close[14:26]) / 12)[25:], means(close, W.A26, 25, sum(close[:26]) / 26)[25:])]
    signal = means(ta, W.A9, 33, sum(ta[25:34]) / 9)
    for i in range(0, 20_000, 37):
        assert got[i].dif == pytest.approx(dif[i], abs=2e-6) and got[i].dea == pytest.approx(dea[i], abs=2e-6)
        assert (got[i].macd is None) == (i < 25) and (i < 33 or got[i].dea_ta == pytest.approx(signal[i], abs=2e-6))
    k = means(rsv := [50.0 if min(l) == max(h) else 100 * (c - min(l)) / (max(h) - min(l)) for c, l, h in ((close[i], [x - 1 for x in close[max(0, i - 8) : i + 1]], [x + 1 for x in close[max(0, i - 8) : i + 1]]) for i in range(20_000))], 1 / 3)
    got = sorted(W.kdj().apply(d).collect(), key=lambda x: x.trade_date)
    assert all(got[i].rsv == pytest.approx(rsv[i], abs=2e-6) and got[i].k == pytest.approx(k[i], abs=2e-6) for i in range(0, 20_000, 37))
    got = sorted(W.rsi().apply(d).collect(), key=lambda x: x.trade_date)
    up, down = ([0.0] + [max(0.0, s * (b - a)) for a, b in zip(close, close[1:])] for s in (1, -1))
    u, v = means(up, W.A14), means(down, W.A14)
    assert all(got[i].rsi_wilder == pytest.approx(100 * u[i] / (u[i] + v[i]), abs=2e-6) for i in range(100, 20_000, 37))


def test_window_families_equal_loops(spark):
    """Definitions in plain Python, for the families whose checking SQL comes from the same text."""
    from panelwright.operators import features as W

    d = bars(spark, 150).selectExpr("*", "1.0D AS vol")
    rows = sorted(d.collect(), key=lambda x: x.trade_date)
    c, h, l = ([getattr(r, x) for r in rows] for x in ("close", "high", "low"))
    of = lambda stages: sorted(stages.apply(d).collect(), key=lambda x: x.trade_date)
    near = lambda x: pytest.approx(x, abs=2e-6)
    ma, boll, rank, wr, ext, q = of(W.moving_averages()), of(W.bollinger()), of(W.range_position()), of(W.momentum()), of(W.since_extremes()), of(W.quantile_bands())
    for i in range(19, 150):
        last = c[i - 19 : i + 1]
        m = sum(last) / 20
        sd = math.sqrt(sum((x - m) ** 2 for x in last) / 20)
        assert ma[i].ma_ratio_20 == near(c[i] / m - 1) and ma[i].bias_20 == near(100 * (c[i] / m - 1))
        assert boll[i].boll_up == near(m + 2 * sd)
        assert rank[i].rank_20 == near((sum(x < c[i] for x in last) + (sum(x == c[i] for x in last) + 1) / 2) / 20)
        assert ext[i].imax_20 == 19 - last.index(max(last)) and ext[i].imin_20 == 19 - last.index(min(last))
        s = sorted(last)
        at = 0.8 * 19
        assert q[i].qtlu_20 == near((s[int(at)] + (at - int(at)) * (s[int(at) + 1] - s[int(at)])) / c[i] - 1)
        assert wr[i].roc_10 == near(100 * (c[i] / c[i - 10] - 1))
    atr, adx = of(W.atr()), of(W.adx())
    tr = [h[0] - l[0]] + [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, 150)]
    for i in range(30, 150):
        assert atr[i].atr_14 == near(sum(tr[i - 13 : i + 1]) / 14)
        moves = [(h[k] - h[k - 1], l[k - 1] - l[k]) for k in range(i - 13, i + 1)]
        up, total = sum(u for u, v in moves if u > v and u > 0), sum(tr[i - 13 : i + 1])
        assert adx[i].pdi == near(100 * up / total)


def test_channel_walk_visits_all_phases():
    from panelwright.operators.channel import next_phase

    def walk(rows):
        phase, days, was, out = None, 0, None, []
        for r in rows:
            f = {k: k in r for k in ("inside", "over", "under", "above", "topped", "weak")}
            phase, days = next_phase(phase, days, was, "below" in r, f)
            was = f["over"]
            out.append((phase, days))
        return out

    low, under, over, top = {"below", "under"}, {"inside", "under"}, {"inside", "over"}, {"inside", "over", "above", "topped"}
    got = walk([under, over, over, low, low, under, over, *[over] * 15, over, top, under, over])
    assert [p for p, _ in got] == ["0D", "0U", "0U", "1", "1", "2", "3B", *["3B"] * 14, "4B", "4B", "4A", "0D", "0U"]
    assert got[2] == ("0U", 2) and got[4] == ("1", 2) and got[-3] == ("4A", 1)
    assert [p for p, _ in walk([low] * 11 + [low])][-2:] == ["0D", "1"]  # ten rows under the channel, then given up
    assert [p for p, _ in walk([low, under, *[under] * 20])][-1] == "3A" and walk([low, under, *[under | {"weak"}] * 5])[-1] == ("3A", 1)
    assert [p for p, _ in walk([low, under, over, top, top, under])] == ["1", "2", "3B", "4A", "4A", "0D"]
    assert [p for p, _ in walk([low, under, over, *[over] * 15, *[over] * 21])][-1] == "0U"


def test_channel_walk_is_the_same_on_a_stream(spark):
    rows = lambda name: sorted((r.symbol, str(r.trade_date), r.phase, r.days) for r in panel.QUERIES[name](spark, SF).where("phase IS NOT NULL").collect())
    got = rows("sm05_channel_walk")
    assert got and got == rows("d10_eight_phases")


def test_correlation_of_constant_groups(spark):
    rows = [("flat", 1.0, float(i)) for i in range(4)] + [("one", 2.0, 3.0), ("none", None, 1.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 9.0, None), ("some", 1.0, 5.0), ("some", 1.0, 7.0), ("some", 4.0, None)]
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.c for r in d.groupBy("k").agg(P.correlation("x", "y").alias("c")).collect()}
    assert math.isnan(got["flat"]) and math.isnan(got["one"]) and math.isnan(got["some"]) and got["none"] is None and got["line"] == pytest.approx(1.0)


def test_layers_with_a_constant_group(spark, monkeypatch):
    from panelwright import further_queries

    rows = [(c, 1, "I0", 0.0 if c == 0 else i / 10, float(i)) for c, n in ((0, 3), (1, 60)) for i in range(n)]
    d = spark.createDataFrame(rows, "cap int, value int, industry string, bias double, r_20 double")
    monkeypatch.setattr(further_queries, "facts", lambda spark, sf_dir: d)
    got = sorted((r.cap or 0, r.value or 0, r.industry or "", r.n, round(r.ic, 6)) for r in further_queries.ev02_layers(spark, "").collect())
    assert [g[3] for g in got] == [63, 63, 60] and got[-1] == (1, 0, "", 60, 1.0)
