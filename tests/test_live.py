"""Streams over several runs: late ticks, halos, open signals and running scores, against plain Python."""
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelwright.operators import panels as P
from panelwright.streaming import live

DAY = dt.date(2024, 1, 1)


def feed(spark, tmp_path, schema, runs, take):
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        take(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))


def test_bars_follow_ticks_and_late_ones_count_within_the_watermark(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    runs = [[("A", at(1, 9), 1.0), ("A", at(2, 9), 2.0)], [("A", at(2, 15), 9.0), ("A", at(1, 11), 4.0), ("B", at(3, 9), 7.0)], [("A", at(1, 23), 5.0), ("A", at(20, 9), 6.0)], [("A", at(1, 8), 99.0), ("A", at(20, 10), 3.0)]]
    seen = []
    path, state = str(tmp_path / "bars"), str(tmp_path / "state")

    def take(s):
        live.follow_bars(s, path, state)
        seen.append({(r.symbol, r.start.day): (r.open, r.high, r.low, r.close, r.n, r.provisional) for r in live.followed_bars(spark, path).collect()})

    feed(spark, tmp_path, "symbol string, ts timestamp, price double", runs, take)
    assert seen[0] == {("A", 1): (1.0, 1.0, 1.0, 1.0, 1, False), ("A", 2): (2.0, 2.0, 2.0, 2.0, 1, True)}
    assert seen[1][("A", 1)] == (1.0, 4.0, 1.0, 4.0, 2, False) and seen[1][("A", 2)] == (2.0, 9.0, 2.0, 9.0, 2, False) and seen[1][("B", 3)][-1]
    assert seen[2][("A", 1)] == (1.0, 5.0, 1.0, 5.0, 3, False)
    assert seen[3][("A", 1)] == seen[2][("A", 1)] and seen[3][("A", 20)] == (6.0, 6.0, 3.0, 3.0, 2, True)  # the last late tick is beyond the watermark
    live.compacted(spark, path, live.BAR, ["symbol", "start"], str(tmp_path / "compact"))
    assert sorted(map(str, live.followed_bars(spark, str(tmp_path / "compact")).collect())) == sorted(map(str, live.followed_bars(spark, path).collect()))


def test_a_batch_run_again_replaces_its_own_rows(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, x int"
    assert live.batches(spark, path, schema).collect() == []
    for batch, rows in ((0, [("a", 1), ("b", 1)]), (1, [("a", 2)]), (1, [("a", 3)])):
        live.write_batch(spark.createDataFrame(rows, schema), path, batch)
    assert sorted(map(tuple, live.latest(live.batches(spark, path, schema), ["k"]).collect())) == [("a", 3), ("b", 1)]


def test_features_of_new_rows_see_the_rows_before_them(spark, tmp_path):
    day = lambda i: DAY + dt.timedelta(i)
    r = random.Random(1)
    rows = [(s, day(i), r.random()) for s in "AB" for i in range(30)]
    part = lambda lo, hi, s="AB": [x for x in rows if lo <= (x[1] - DAY).days < hi and x[0] in s]
    runs = [part(0, 12), part(12, 15, "A"), [*part(15, 30, "A"), *part(12, 30, "B"), ("A", day(3), 9.0)]]
    mean = lambda d: d.select("symbol", "trade_date", F.sum("x").over(P.by_time().rowsBetween(-4, 0)).alias("m"), "__new")
    feed(spark, tmp_path, "symbol string, trade_date date, x double", runs, lambda s: live.follow_features(s, str(tmp_path / "f"), str(tmp_path / "h"), str(tmp_path / "c"), mean, 4))
    got = {(x.symbol, x.trade_date): x.m for x in live.batches(spark, str(tmp_path / "f"), "symbol string, trade_date date, m double").collect()}
    assert len(got) == 60  # the old row that came again is left out
    for s in "AB":
        xs = [x for k, _, x in rows if k == s]
        assert [got[(s, day(i))] for i in range(30)] == pytest.approx([sum(xs[max(0, i - 4) : i + 1]) for i in range(30)])


def test_signals_open_before_and_closed_after(spark, tmp_path):
    day = lambda i: DAY + dt.timedelta(i)
    r = random.Random(2)
    close = [100 + r.gauss(0, 3) for _ in range(60)]
    bar = lambda i: ("A", day(i), 0, -1, close[i])
    signal = lambda n, i: ("A", day(i), 1, n, None)
    skipped = 7  # a day without a bar
    bars = lambda lo, hi: [bar(i) for i in range(lo, hi) if i != skipped]
    runs = [[*bars(0, 10), signal(1, 3), signal(2, 9), signal(3, skipped)], [*bars(10, 28), signal(4, 5), signal(5, 40), bar(2)], [*bars(28, 60), signal(6, 1), signal(7, 59), ("B", day(1), 1, 8, None)]]
    feed(spark, tmp_path, "symbol string, trade_date date, is_signal int, id long, close double", runs, lambda s: live.follow_outcomes(s, str(tmp_path / "o"), str(tmp_path / "c")))
    got = {x.id: x for x in live.outcomes(spark, str(tmp_path / "o")).collect()}
    assert {n: x.status for n, x in got.items()} == {1: "closed", 2: "closed", 3: "no_bar", 4: "closed", 5: "open", 6: "too_late", 7: "open", 8: "waiting"}
    days = [i for i in range(60) if i != skipped]
    for n, i in ((1, 3), (2, 9), (4, 5), (5, 40)):
        later = [100 * (close[j] / close[i] - 1) for j in days if j > i][:20]
        x = got[n]
        assert x.filled == len(later) and x.base == close[i] and x.ret == pytest.approx(later[-1])
        assert [x[f"ret_{k}"] for k in live.STEPS if k <= len(later)] == pytest.approx([later[k - 1] for k in live.STEPS if k <= len(later)])
        assert (x.max_drawdown_5, x.max_gain_10) == pytest.approx((min(later[:5]), max(later[:10])))
    assert got[5].ret_20 is None and got[7].filled == 0 and got[7].max_gain_5 is None


def test_scores_against_their_last_n(spark, tmp_path):
    day = lambda i: DAY + dt.timedelta(i)
    r = random.Random(3)
    raw = {s: [r.gauss(50, sd) for _ in range(25)] for s, sd in (("A", 3), ("B", 30))}
    rows = [(s, day(i), x) for s, xs in raw.items() for i, x in enumerate(xs)]
    cut = lambda lo, hi: [x for x in rows if lo <= (x[1] - DAY).days < hi]
    feed(spark, tmp_path, "symbol string, trade_date date, raw double", [cut(0, 4), cut(4, 9), [*cut(9, 25), ("A", day(2), 1.0), ("A", day(40), None)]], lambda s: live.follow_scores(s, str(tmp_path / "s"), str(tmp_path / "c"), keep=8, least=5))
    got = {(x.symbol, x.trade_date): x for x in live.batches(spark, str(tmp_path / "s"), live.SCORE).collect()}
    assert len(got) == 50
    for s, xs in raw.items():
        for i, x in enumerate(xs):
            h = xs[max(0, i - 7) : i + 1]
            g = got[(s, day(i))]
            if len(h) < 5:
                assert (g.score, g.reason) == (x, "cold_start")
            elif statistics.stdev(h) >= 12:
                assert (g.score, g.reason) == (x, "sigma_ok")
            else:
                assert g.reason == "stretched" and g.score == pytest.approx(max(5, min(95, 55 + 18 * (x - statistics.mean(h)) / statistics.stdev(h))))
    assert {g.reason for g in got.values()} == {"cold_start", "sigma_ok", "stretched"}


def test_signals_of_a_date_are_followed_together():
    """Bars pass by dates: the work of a symbol's run doesn't grow with the signals of a date; an id that comes again is the later signal."""
    import pandas as pd

    class State:
        def __init__(self):
            self.rows = None

        exists, get, put, clear = lambda self: self.rows is not None, lambda self: iter(self.rows), lambda self, rows: setattr(self, "rows", rows), lambda self: setattr(self, "rows", None)

    class Counted(live.Outcomes):
        calls = 0

        @staticmethod
        def passed(s, day, close):
            Counted.calls += 1
            live.Outcomes.passed(s, day, close)

    p, days = Counted(), [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(30)]
    p.open, p.ring = State(), State()
    bars = lambda at: [(d, 0, -1, 100.0 + i) for i, d in enumerate(days) if i in at]
    take = lambda rows: pd.concat(p.handleInputRows(("A",), iter([pd.DataFrame(rows, columns=["trade_date", "is_signal", "id", "close"])]), None)).set_index("id")
    got = take(bars(range(10)) + [(days[2], 1, i, None) for i in range(2000)])
    assert len(got) == 2000 and set(got.status) == {"open"} and set(got.filled) == {7}
    got = take(bars(range(10, 30)) + [(days[12], 1, 7, None)])
    assert len(got) == 2000 and Counted.calls < 100 and set(got.drop(7).status) == {"closed"} and got.loc[7, "filled"] == 17 and got.loc[7, "base"] == 112.0
    assert got.loc[1, "ret_20"] == pytest.approx(100 * (122 / 102 - 1)) and p.open.rows[0][0] == [7]
