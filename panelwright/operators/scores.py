"""Scores, states and decisions as column builders (SR, D) over named inputs; parameters carry the fixed values.

All are plain CASE, least and greatest expressions in SQL text: they stay in whole-stage code.
"""
from __future__ import annotations

from ..functions.windows import back, clip, flag, lag, over, ratio, roll
from .features import PCT, PREV, adx, macd, market_regime, rsi
from .spec import Stages


def anchored(x: str, p5: float, p50: float, p95: float) -> str:
    """0 at p5, 50 at p50, 100 at p95, linear between, flat outside."""
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {p5} THEN 0.0 WHEN {x} >= {p95} THEN 100.0 WHEN {x} < {p50} THEN 50 * (({x}) - {p5}) / {p50 - p5!r} ELSE 50 + 50 * (({x}) - {p50}) / {p95 - p50!r} END)"


def erf(x: str) -> str:
    """Error function within 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


BASE = {"c5": f"{ratio('close', lag('close', 5))} - 1", "c20": f"{ratio('close', lag('close', 20))} - 1", "ma20": roll("avg", "close", 20, 5), "ma60": roll("avg", "close", 60, 20), "hi60": roll("max", "high", 60, 20), "lo60": roll("min", "low", 60, 20), "vr": ratio("vol", roll("avg", "vol", 20, 5))}
INPUT = {"place": ratio("close - lo60", "hi60 - lo60"), "bias": f"100 * ({ratio('close', 'ma20')} - 1)", "trend": f"100 * ({ratio('ma20', 'ma60')} - 1)"}


def indicator_scores() -> Stages:
    """Six single scores of 0 to 100, 50 for unknown inputs."""
    s = {
        "s_trend": f"coalesce({clip('50 + 12 * trend', 0.0, 100.0)}, 50.0)",
        "s_momentum": f"coalesce({clip('50 + 400 * c20', 0.0, 100.0)}, 50.0)",
        "s_reversal": f"coalesce({clip('50 - 10 * bias', 0.0, 100.0)}, 50.0)",
        "s_volume": "CASE WHEN vr IS NULL THEN 50.0 WHEN vr > 2 AND c5 > 0 THEN 75.0 WHEN vr > 2 THEN 30.0 WHEN vr < 0.5 THEN 45.0 ELSE 55.0 END",
        "s_place": f"coalesce({anchored('place', 0.1, 0.5, 0.9)}, 50.0)",
        "s_calm": f"coalesce({clip('70 - 3000 * abs(c5)', 0.0, 100.0)}, 50.0)",
    }
    return Stages("bars", (BASE, INPUT, s), tuple(s))


KEYS = ("s_trend", "s_momentum", "s_reversal", "s_volume", "s_place", "s_calm")
WEIGHTS = {"s_trend": 0.3, "s_momentum": 0.2, "s_reversal": 0.1, "s_volume": 0.15, "s_place": 0.15, "s_calm": 0.1}


def composites() -> Stages:
    """A: weighted mean with a pull to the key dimension; B: fewer inputs, stretched by 2.5; C: inputs in the neutral zone weigh nothing."""
    mean = " + ".join(f"{w} * {k}" for k, w in WEIGHTS.items())
    active = {k: f"(CASE WHEN abs({k} - 50) < 8 THEN 0.0 ELSE {w} END)" for k, w in WEIGHTS.items()}
    c = ratio(" + ".join(f"{a} * {k}" for k, a in active.items()), " + ".join(active.values()))
    s = {"raw_a": mean, "b0": "(s_trend + s_momentum + s_place) / 3", "comp_c": f"coalesce({c}, 50.0)"}
    t = {"comp_a": clip("raw_a + 0.25 * (CASE WHEN s_trend > 70 THEN s_trend - 70 WHEN s_trend < 30 THEN s_trend - 30 ELSE 0.0 END)", 0.0, 100.0), "comp_b": clip("50 + 2.5 * (b0 - 50)", 0.0, 100.0)}
    return Stages("bars", (BASE, INPUT, dict(indicator_scores().stages[2]), s, t), ("comp_a", "comp_b", "comp_c"))


def stretched() -> Stages:
    """Scores of a date stretched to mean 55 and deviation 18 where they lie closer than 12 and are 5 or more."""
    base = composites()
    x = over(key="trade_date", order=None)
    s = {"m": f"avg(raw_a) {x}", "sd": f"stddev_samp(raw_a) {x}", "n": f"count(raw_a) {x}"}
    return Stages("bars", (*base.stages, s, {"stretched": f"(CASE WHEN n >= 5 AND sd > 0 AND sd < 12 THEN {clip('55 + 18 * (raw_a - m) / nullif(sd, 0)', 0.0, 100.0)} ELSE raw_a END)"}), ("raw_a", "stretched"))


def resonance() -> Stages:
    """Agreement of the trend over 5, 20 and 60 rows, where the longest has a veto."""
    s = {f"t{n}": f"coalesce(sign({ratio('close', lag('close', n))} - 1), 0)" for n in (5, 20, 60)}
    r = "(CASE WHEN t60 < 0 AND t5 > 0 THEN least(50.0, 50 + 10 * (t5 + t20)) WHEN t5 = t20 AND t20 = t60 THEN 50 + 35 * t5 ELSE 50 + 8 * (t5 + t20 + t60) END)"
    return Stages("bars", (s, {"resonance": r}), ("t5", "t20", "t60", "resonance"))


def entry_risk() -> Stages:
    e = " + ".join([flag("trend > 0") + " * 20", flag("place BETWEEN 0.3 AND 0.7") + " * 20", flag("vr > 1.2") + " * 15", flag("c5 > 0 AND c5 < 0.05") + " * 15", flag("bias BETWEEN -2 AND 1") + " * 30"])
    r = " + ".join([flag("place > 0.9") + " * 30", flag("bias > 3") + " * 25", flag("vr > 3") + " * 20", flag("c20 < -0.05") + " * 25"])
    return Stages("bars", (BASE, INPUT, {"entry": e, "risk": r}), ("entry", "risk"))


def quadrants() -> Stages:
    """Buy and sell scores by date percentile: ideal, hot, dull or avoid; and the blend."""
    base = entry_risk()
    q = "(CASE WHEN entry >= 50 AND risk < 30 THEN 'ideal' WHEN entry >= 50 THEN 'hot' WHEN risk < 30 THEN 'dull' ELSE 'avoid' END)"
    pool = "(CASE WHEN entry >= 70 AND risk = 0 THEN 'core' WHEN entry >= 50 AND vr > 1.5 THEN 'breakout' WHEN place < 0.2 AND c5 > 0 THEN 'rebound' WHEN risk >= 50 THEN 'watch' ELSE 'none' END)"
    size = clip("0.02 + 0.001 * (entry - risk)", 0.0, 0.08)
    return Stages("bars", (*base.stages, {"quadrant": q, "pool": pool, "size": size, "blend": "0.6 * entry + 0.4 * (100 - risk)"}), ("size", "blend"), ("symbol", "trade_date", "quadrant", "pool"))


def exits() -> Stages:
    """First rule that holds for a position opened 20 rows ago: stop, target, time, zombie, else hold."""
    s = {"gain": f"100 * ({ratio('close', lag('open', 19))} - 1)", "spread": f"100 * ({ratio(roll('max', 'high', 20), roll('min', 'low', 20))} - 1)"}
    return Stages("bars", (s, {"exit_rule": "(CASE WHEN gain IS NULL THEN 'none' WHEN gain <= -8 THEN 'stop' WHEN gain >= 5 THEN 'target' WHEN spread < 4 THEN 'zombie' WHEN gain < 0 THEN 'time' ELSE 'hold' END)"}), ("gain",), ("symbol", "trade_date", "exit_rule"))


def exposure() -> Stages:
    """Market exposure by regime, its dominant regime of three rows, and triggers that lower it."""
    r = market_regime()
    s = {"r1": lag("regime"), "r2": lag("regime", 2)}
    t = {"dominant": "(CASE WHEN regime = r1 OR regime = r2 THEN regime WHEN r1 = r2 THEN r1 ELSE regime END)"}
    e = {"exposure": "least((CASE dominant WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.2 WHEN 4 THEN 0.4 ELSE 0.5 END), (CASE WHEN sigma_20 > 0.02 THEN 0.4 ELSE 1.0 END), (CASE WHEN ret_5 < -0.03 THEN 0.3 ELSE 1.0 END))"}
    return Stages("market", (*r.stages, s, t, e), ("regime", "dominant", "exposure"))


def probability_tiers() -> Stages:
    """Chance that the next 20 rows gain, by the normal curve of the last 60 returns; lift and risk tiers."""
    s = PREV
    t = PCT
    u = {"m": roll("avg", "pct", 60, 20), "sd": roll("stddev_samp", "pct", 60, 20)}
    z = ratio("m * sqrt(20)", "sd * sqrt(2)")
    return Stages("bars", (s, t, u, {"z": z}, {"p_gain": f"0.5 * (1 + {erf('z')})"}, {"tier": "(CASE WHEN p_gain IS NULL THEN 0 WHEN p_gain >= 0.6 THEN 3 WHEN p_gain >= 0.5 THEN 2 ELSE 1 END)"}), ("p_gain", "tier"))


def fundamental_bias() -> Stages:
    """Bias from ratio, size and growth of turnover, each null-safe."""
    g = {"growth": f"{ratio('amount', lag('amount', 4))} - 1"}
    b = "(CASE WHEN pe IS NULL THEN 0 WHEN pe < 0 THEN -8 WHEN pe < 15 THEN 6 WHEN pe > 80 THEN -5 ELSE 0 END) + (CASE WHEN growth > 0.3 THEN 5 WHEN growth < -0.3 THEN -5 ELSE 0 END) + (CASE WHEN total_mv > 1000 THEN 2 WHEN total_mv < 50 THEN -2 ELSE 0 END)"
    return Stages("panel", (g, {"bias_points": b}), ("bias_points",))


def combinations() -> Stages:
    s = {"combo_1": "place * vr", "combo_2": "place * trend", "combo_3": "bias * vr", "combo_4": "(1 - place) * c5", "combo_5": "trend - bias", "combo_6": "c5 - c20", "combo_7": "vr * abs(c5)"}
    return Stages("bars", (BASE, INPUT, s), tuple(s))


def rule_engine() -> Stages:
    """Decision and size from a snapshot of RSI, MACD and DMI."""
    m, r, a = macd(), rsi(), adx()
    stages = (*m.stages, *({k: v for k, v in s.items() if k != "i"} for s in r.stages), *({k: v for k, v in s.items() if k not in ("i", "pc", "pv")} for s in a.stages))
    s = {"points": " + ".join([flag("hist > 0") + " * 2", flag("rsi_14 BETWEEN 40 AND 65") + " * 2", flag("pdi > mdi") + " * 2", flag("adx > 20") + " * 1", flag("rsi_14 > 75") + " * -3"])}
    d = {"decision": "(CASE WHEN points >= 6 THEN 'buy' WHEN points >= 4 THEN 'hold' WHEN points <= 0 THEN 'sell' ELSE 'wait' END)", "position": clip("0.01 * (points - 2)", 0.01, 0.05)}
    return Stages("bars", (*stages, s, d), ("points", "position"), ("symbol", "trade_date", "decision"))


# Detectors -----------------------------------------------------------------------------------------------


def candles() -> Stages:
    """Named patterns of one to three bars, each a flag, and the first that holds."""
    p = {f"{c}{k}": lag(c, k) for k in (1, 2) for c in ("open", "high", "low", "close")}
    b = {"body": "abs(close - open)", "span": "high - low", "top": "high - greatest(open, close)", "tail": "least(open, close) - low", "b1": "abs(close1 - open1)", "b2": "abs(close2 - open2)"}
    n = {
        "doji": "body <= 0.1 * span AND span > 0", "hammer": "tail >= 2 * body AND top <= 0.3 * body AND body > 0", "shooting_star": "top >= 2 * body AND tail <= 0.3 * body AND body > 0", "marubozu": "body >= 0.95 * span AND span > 0",
        "bull_engulfing": "close1 < open1 AND close > open AND open <= close1 AND close >= open1", "bear_engulfing": "close1 > open1 AND close < open AND open >= close1 AND close <= open1",
        "piercing": "close1 < open1 AND close > open AND open < low1 AND close > (open1 + close1) / 2 AND close < open1", "dark_cloud": "close1 > open1 AND close < open AND open > high1 AND close < (open1 + close1) / 2 AND close > open1",
        "bull_harami": "close1 < open1 AND close > open AND open >= close1 AND close <= open1", "bear_harami": "close1 > open1 AND close < open AND open <= close1 AND close >= open1",
        "morning_star": "close2 < open2 AND b1 < 0.4 * b2 AND close > open AND close > (open2 + close2) / 2", "evening_star": "close2 > open2 AND b1 < 0.4 * b2 AND close < open AND close < (open2 + close2) / 2",
        "three_soldiers": "close > open AND close1 > open1 AND close2 > open2 AND close > close1 AND close1 > close2", "three_crows": "close < open AND close1 < open1 AND close2 < open2 AND close < close1 AND close1 < close2",
    }
    flags = {f"is_{k}": flag(c) for k, c in n.items()}
    first = "(CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in n.items()) + " ELSE 'none' END)"
    return Stages("bars", (p, b, flags | {"pattern": first}), tuple(flags), ("symbol", "trade_date", "pattern"))


def divergence() -> Stages:
    """Price at a new 20-row extreme that RSI does not confirm."""
    r = rsi()
    f = over("ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING")
    s = {"top_div": flag(f"close > max(close) {f} AND rsi_14 < max(rsi_14) {f}"), "bottom_div": flag(f"close < min(close) {f} AND rsi_14 > min(rsi_14) {f}")}
    return Stages("bars", (*r.stages, s), ("top_div", "bottom_div"))


def volume_price_signals() -> Stages:
    s = PREV | {"h20": f"max(high) {over('ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING')}", "l20": f"min(low) {over('ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING')}", "vr": ratio("vol", roll("avg", "vol", 20, 5)), "ma20": roll("avg", "close", 20, 5)}
    t = PCT
    out = {"vp_breakout": flag("close > h20 AND vr > 1.5"), "vp_pullback": flag("pct < 0 AND vr < 0.7 AND close > ma20"), "vp_bottom": flag("low <= l20 AND vr > 2"), "vp_climax": flag("close >= h20 AND vr > 3")}
    return Stages("bars", (s, t, out, {"vp_score": clip("50 + 20 * vp_breakout + 10 * vp_pullback + 12 * vp_bottom - 18 * vp_climax", 0.0, 100.0)}), (*out, "vp_score"))


def fractals() -> Stages:
    """Tops and bottoms: an extreme of two rows before and two after, known two rows later."""
    f = over("ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING")
    s = {"top_f": flag(f"high = max(high) {f} AND count(high) {f} = 5"), "bottom_f": flag(f"low = min(low) {f} AND count(low) {f} = 5")}
    return Stages("bars", (s, {"n_tops_60": f"sum(top_f) {over(back(60))}", "n_bottoms_60": f"sum(bottom_f) {over(back(60))}", "resistance": f"max(CASE WHEN top_f > 0 THEN high END) {over(back(60))}", "support": f"min(CASE WHEN bottom_f > 0 THEN low END) {over(back(60))}"}, {"to_resistance": f"100 * ({ratio('resistance', 'close')} - 1)", "to_support": f"100 * ({ratio('close', 'support')} - 1)"}), ("top_f", "bottom_f", "n_tops_60", "n_bottoms_60", "resistance", "support", "to_resistance", "to_support"))


def breakout_confirmed() -> Stages:
    """Rows that a break of the prior 60-row high has lasted, its volume, and whether it was tested again."""
    s = {"level": f"max(high) {over('ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING')}", "vr": ratio("vol", roll("avg", "vol", 20, 5))}
    t = {"above_5": roll("sum", flag("close > level"), 5, 1), "tested": flag(f"min(low) {over(back(5))} <= level * 1.005"), "vr5": roll("max", "vr", 5, 1)}
    return Stages("bars", (s, t, {"breakout": "(CASE WHEN level IS NULL THEN 0 WHEN above_5 >= 3 AND vr5 > 1.3 THEN 2 WHEN above_5 >= 1 THEN 1 ELSE 0 END)"}), ("level", "above_5", "tested", "vr5", "breakout"))


def trend_state() -> Stages:
    s = {f"ma{n}": roll("avg", "close", n) for n in (5, 20, 60)}
    c = "(CASE WHEN ma60 IS NULL THEN 'unknown' WHEN ma5 > ma20 AND ma20 > ma60 AND close > ma5 THEN 'strong_up' WHEN ma5 > ma20 AND ma20 > ma60 THEN 'up' WHEN ma5 > ma20 THEN 'turning_up' WHEN ma5 < ma20 AND ma20 < ma60 AND close < ma5 THEN 'strong_down' WHEN ma5 < ma20 AND ma20 < ma60 THEN 'down' WHEN ma5 < ma20 THEN 'turning_down' ELSE 'flat' END)"
    return Stages("bars", (s, {"state": c}), ("ma5", "ma20", "ma60"), ("symbol", "trade_date", "state"))


def combo_label() -> Stages:
    """Five bars in one label by their direction and net move."""
    s = {"ups": roll("sum", flag("close > open"), 5, 5), "net": f"{ratio('close', lag('close', 4))} - 1"}
    return Stages("bars", (s, {"combo": "(CASE WHEN ups IS NULL THEN 'none' WHEN ups = 5 THEN 'five_up' WHEN ups = 0 THEN 'five_down' WHEN ups >= 4 AND net > 0 THEN 'advance' WHEN ups <= 1 AND net < 0 THEN 'decline' WHEN abs(net) < 0.005 THEN 'flat' ELSE 'mixed' END)"}), ("ups", "net"), ("symbol", "trade_date", "combo"))


def anomaly() -> Stages:
    """Normal, warning or severe by the move since the bar before and its volume."""
    s = PREV | {"vr": ratio("vol", roll("avg", "vol", 20, 5))}
    return Stages("bars", (s, PCT, {"anomaly": "(CASE WHEN pct IS NULL THEN 'none' WHEN abs(pct) > 0.06 AND vr > 1.5 THEN 'severe' WHEN abs(pct) > 0.04 THEN 'warning' ELSE 'normal' END)"}), ("pct", "vr"), ("symbol", "trade_date", "anomaly"))


SCORES = {
    "sr01_indicator_scores": indicator_scores, "sr02_resonance": resonance, "sr03_composites": composites, "sr08_stretched": stretched, "sr12_entry_risk": entry_risk, "sr16_quadrants_pools": quadrants, "sr19_exits": exits,
    "sr20_exposure": exposure, "sr21_rule_engine": rule_engine, "sr23_combinations": combinations, "sr24_fundamental_bias": fundamental_bias, "sr27_probability_tiers": probability_tiers,
    "d01_candles": candles, "d02_combo_label": combo_label, "d03_divergence": divergence, "d04_volume_price": volume_price_signals, "d05_levels": fractals, "d06_breakout": breakout_confirmed, "d12_trend_state": trend_state, "d15_anomaly": anomaly,
}
