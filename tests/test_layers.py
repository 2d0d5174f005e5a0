"""The layered score on a small validity table, its numbers worked out by hand, and the table itself against plain Python."""
import random

import pytest

from panelwright.operators import layers
from tests.conftest import SF

MA, CH, SU, TX, MH, RS = (-0.04, -0.01, 0.02, 0.06), (0.2, 0.4, 0.6, 0.8), (10.0, 15.0, 20.0, 25.0), (-0.2, 0.0, 0.2, 0.5), (-0.3, -0.1, 0.1, 0.3), (35.0, 45.0, 55.0, 60.0)
TABLE = [
    ("ma_ratio_60", "mv", "0", MA, (0.65, 0.58, 0.55, 0.52, 0.45), True), ("ma_ratio_60", "industry", "E", MA, (0.61, 0.56, 0.55, 0.54, 0.50), False), ("ma_ratio_60", "mv", "4", MA, (0.54, 0.55, 0.55, 0.56, 0.56), True),
    ("channel_pos_60", "mv", "0", CH, (0.63, 0.57, 0.55, 0.53, 0.47), True), ("sump_20", "mv", "0", SU, (0.62, 0.57, 0.55, 0.52, 0.45), True), ("trix", "mv", "0", TX, (0.60, 0.56, 0.55, 0.52, 0.47), True),
    ("macd_hist", "mv", "4", MH, (0.46, 0.50, 0.55, 0.58, 0.63), True), ("rsi_24", "mv", "4", RS, (0.47, 0.50, 0.55, 0.58, 0.62), True),
    ("atr_pct", "industry", "H", (0.02, 0.03, 0.04, 0.05), (0.70, 0.60, 0.55, 0.50, 0.45), True), ("sump_20", "industry", "H", SU, (0.66, 0.60, 0.55, 0.50, 0.45), True), ("sump_20", "pe", "5", SU, (0.45, 0.50, 0.55, 0.60, 0.70), True),
    ("roc_20", "mv", "0", MH, (0.95, 0.50, 0.55, None, 0.62), False), ("roc_20", "mv", "4", MH, (0.95, 0.50, 0.55, None, 0.62), True),
]


def run(spark, rows, **kw):
    """rows: symbol -> (factors, context)."""
    table = spark.createDataFrame(
        [(f, d, s, list(th), list(w), [100 * (x - 0.5) if x is not None else None for x in w], [1000] * 5, w[2], a) for f, d, s, th, w, a in TABLE],
        "factor string, dim string, seg string, thresholds array<double>, wins array<double>, avgs array<double>, ns array<long>, q3_win double, active boolean",
    )
    long = [(s, n, v, *(c.get(k) for k in ("mv", "pe", "industry")), c.get("etf", False), c.get("state"), c.get("trend")) for s, (fs, c) in rows.items() for n, v in fs.items()]
    d = spark.createDataFrame(long, "symbol string, name string, value double, mv string, pe string, industry string, etf_held boolean, mf_state string, trend string")
    return {r.symbol: r for r in layers.layered_score(d, table, keys=["symbol"], **kw).collect()}


SMALL = {"mv": "0", "pe": "2", "industry": "E"}
LARGE = {"mv": "4", "pe": "2", "industry": "C", "etf": True, "trend": "slow_bull"}
SCENARIOS = {
    "fallen small cap": ({"ma_ratio_60": -0.06, "channel_pos_60": 0.10, "sump_20": 8.0, "rsi_24": 35.0}, SMALL),
    "risen small cap": ({"ma_ratio_60": 0.20, "channel_pos_60": 0.92, "sump_20": 35.0, "trix": 0.8}, {**SMALL, "industry": "S"}),
    "large cap starts to move": ({"macd_hist": 0.5, "rsi_24": 65.0, "ma_ratio_60": 0.05}, {**LARGE, "state": "main_inflow_3d"}),
    "weak large cap": ({"macd_hist": -0.6, "rsi_24": 30.0, "ma_ratio_60": -0.08}, {**LARGE, "state": "main_outflow_3d"}),
    "factors in conflict": ({"ma_ratio_60": -0.06, "channel_pos_60": 0.10, "trix": 0.7, "sump_20": 35.0}, SMALL),
    "calm industry": ({"atr_pct": 0.018, "sump_20": 9.0, "unheard_of": 1.0}, {"mv": "2", "pe": "2", "industry": "H", "etf": True, "trend": "slow_bull", "state": "main_inflow_3d"}),
}
WANT = {
    "fallen small cap": (56.9, 6.9, 0.0, "high", 3, 1, "hold"), "risen small cap": (39.2, -10.8, 0.0, "high", 4, 0, "reduce"), "large cap starts to move": (56.43, 6.43, 0.0, "low", 2, 1, "hold"),
    "weak large cap": (42.71, -7.29, 0.0, "low", 2, 1, "reduce"), "factors in conflict": (49.64, -0.6, 0.48, "low", 4, 0, "reduce"), "calm industry": (57.47, 7.47, 0.0, "low", 2, 0, "hold"),
}


def test_six_scenarios(spark):
    got = run(spark, SCENARIOS)
    for name, (score, total, conflict, sure, active, silent, signal) in WANT.items():
        r = got[name]
        assert (r.layered_score, r.sum_delta, r.conflict) == pytest.approx((score, total, conflict), abs=1e-9), name
        assert (r.confidence, r.n_active, r.n_silent, r.signal) == (sure, active, silent, signal), name
    first = got["fallen small cap"].active[0]
    assert (first.name, first.q, first.w_eff, first.q3_eff, first.delta) == ("channel_pos_60", 1, 0.63, 0.55, 2.4)
    assert [(s.name, s.reason) for s in got["fallen small cap"].silent] == [("rsi_24", "no_segment")]
    assert [(a.name, a.delta, a.regime_mul, a.etf_mul, a.gate) for a in got["large cap starts to move"].active] == [("macd_hist", 3.43, 1.1, 1.3, "mf_inflow_confirm"), ("rsi_24", 3.0, 1.1, 1.3, "mf_inflow_confirm")]
    assert {a.gate for a in got["weak large cap"].active} == {"mf_outflow_confirm"} and got["factors in conflict"].k_weight == 0.6


def test_gates_clamp_and_silence(spark):
    got = run(spark, {
        "veto": ({"ma_ratio_60": -0.06}, {**SMALL, "state": "main_outflow_3d"}), "halved": ({"ma_ratio_60": -0.06}, {**SMALL, "state": "neutral"}), "sell halved": ({"ma_ratio_60": 0.2}, {**SMALL, "industry": None, "state": "main_inflow"}),
        "clamped": ({"roc_20": -0.5}, LARGE), "no active segment": ({"roc_20": -0.5}, SMALL), "no rate": ({"roc_20": 0.2}, LARGE), "disagree": ({"sump_20": 35.0}, {"mv": "0", "pe": "5"}),
        "small held": ({"ma_ratio_60": -0.06}, {"mv": "0", "etf": True, "trend": "bear"}), "null": ({"ma_ratio_60": None, "sump_20": 12.0}, SMALL),
    })
    reason = lambda s: [x.reason for x in got[s].silent]
    assert reason("veto") == ["too_small"] and got["veto"].layered_score == 50 and got["veto"].confidence == "none"
    assert got["halved"].sum_delta == 1.2 and got["sell halved"].sum_delta == -1.5
    assert got["clamped"].sum_delta == 8.0 and reason("no active segment") == ["no_active_segment"] and reason("no rate") == ["not_extreme"] and reason("disagree") == ["dims_disagree"]
    assert got["small held"].sum_delta == pytest.approx(round(3 * 1.2 * 0.7, 2)) and got["null"].n_active + got["null"].n_silent == 1


def test_means_instead_of_rates_and_shrinking(spark):
    rows = {"a": ({"ma_ratio_60": -0.06}, SMALL)}
    assert run(spark, rows, mode="avg")["a"].sum_delta == 8.0  # excess of 10 and 6 percent, mean 8, clamped at 8
    assert run(spark, rows, mode="avg", scale=3.0)["a"].sum_delta == 0.8
    assert run(spark, rows, shrink=1000)["a"].sum_delta == 1.5  # half of 10 points stays, half of 6 is no longer extreme
    assert run(spark, SCENARIOS, damped=False)["factors in conflict"].layered_score == 49.4


def percentile(xs, p):
    xs, at = sorted(xs), (len(xs) - 1) * p
    lo = int(at + 1e-9)
    return xs[lo] if lo + 1 >= len(xs) else xs[lo] + (at - lo) * (xs[lo + 1] - xs[lo])


def test_validity_table_equals_plain_counting(spark):
    r = random.Random(3)
    rows = [(f"f{r.randint(0, 1)}", "mv", str(r.randint(0, 2)), round(r.gauss(0, 1), 1), r.gauss(0.1, 1)) for _ in range(900)] + [("f0", "mv", None, 1.0, 1.0), ("f0", "mv", "0", None, 1.0), ("f0", "mv", "0", 1.0, None), ("f1", "pe", "9", 2.0, 1.0)]
    got = {(x.factor, x.dim, x.seg): x for x in layers.validity_table(spark.createDataFrame(rows, "factor string, dim string, seg string, value double, r double")).collect()}
    whole = [x for x in rows if None not in x]
    assert set(got) == {x[:3] for x in whole}
    for key, t in got.items():
        own = [(v, y) for *k, v, y in whole if tuple(k) == key]
        th = [percentile([v for v, _ in own], p) for p in layers.SHARES]
        assert t.thresholds == pytest.approx(th, abs=1e-9)
        fifths = [[y for v, y in own if 1 + sum(round(b, 12) <= v for b in th) == q] for q in range(1, 6)]
        wins = [sum(y > 0 for y in f) / len(f) if len(f) >= 20 else None for f in fifths]
        assert [n or 0 for n in t.ns] == [len(f) for f in fifths] and t.wins == pytest.approx(wins)
        assert t.active == (wins[2] is not None and max(w for w in wins if w is not None) - wins[2] >= 0.05)


def test_layered_score_reads_its_lines_once(spark):
    """What scores and their table are made of is written once: no scan of the lines is left in the plan."""
    from panelwright import layer_queries

    for f in (layer_queries.sr10_active_factors, layer_queries.sr10_silent_factors, layer_queries.sr10_layered_score):
        assert "l_orderkey" not in f(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
