"""Rolling features of bars and of tiered money flow, by family (W1 to W55).

Every family is a `Stages`: columns over one (symbol, trade_date) window per stage. Nested features
(a mean of a mean) take a stage each and keep the distribution, so a family has one shuffle.
"""
from __future__ import annotations

from ..functions.windows import back, before, clip, flag, lag, over, ratio, recursive, roll, roll2, running, wma
from .spec import Stages

ROW = {"i": f"CAST(row_number() {over()} - 1 AS DOUBLE)"}
PREV = {"pc": lag("close"), "pv": lag("vol")}
PCT = {"pct": f"{ratio('close', 'pc')} - 1"}


def _stage(source: str, *stages: dict[str, str], keep: str, **more) -> Stages:
    return Stages(source, stages, tuple(keep.split()), **more)


def moving_averages() -> Stages:
    ma = {f"ma{n}": roll("avg", "close", n, n // 2) for n in (5, 10, 20, 60, 120)}
    out = {f"ma_ratio_{n}": f"{ratio('close', f'ma{n}')} - 1" for n in (5, 10, 20, 60, 120)}
    out |= {"ma5_ma20": f"{ratio('ma5', 'ma20')} - 1", "ma20_ma60": f"{ratio('ma20', 'ma60')} - 1"} | {f"bias_{n}": f"100 * ({ratio('close', f'ma{n}')} - 1)" for n in (5, 10, 20)}
    return _stage("bars", ma, out, keep=" ".join(out))


A12, A26, A9, A14 = 2 / 13, 2 / 27, 0.2, 1 / 14


def macd() -> Stages:
    """From the first close on, and with means seeded by the plain means of 12, 26 and 9 rows (null before row 25, dea_ta and macd_hist before row 33)."""
    seed = {f"m{n}": f"avg(close) {over(back(n))}" for n in (12, 26)}
    ta = recursive(25, t12=("close", A12, "m12"), t26=("close", A26, "m26"))
    plain = recursive(e12=("close", A12), e26=("close", A26))
    both = [a | b for a, b in zip(plain, ta)]
    signal = [a | b for a, b in zip(recursive(dea=("dif", A9)), recursive(33, dea_ta=("macd", A9, "m9")))]
    return _stage("bars", ROW | seed, *both, {"dif": "e12 - e26", "macd": "t12 - t26"}, {"m9": f"avg(macd) {over(back(9))}"}, *signal, {"hist": "2 * (dif - dea)", "macd_hist": "macd - dea_ta"}, keep="dif dea hist macd dea_ta macd_hist")


def rsi() -> Stages:
    """Ratio RSI of 6, 14 and 24 rows, Wilder's, and the one whose weights are divided by their sum (rsi_adjusted)."""
    stages: list[dict[str, str]] = [PREV | ROW, {"up": "(CASE WHEN close > pc THEN close - pc ELSE 0.0 END)", "down": "(CASE WHEN close < pc THEN pc - close ELSE 0.0 END)"}]
    stages.append({f"{k}{n}": roll("avg", k, n) for k in ("up", "down") for n in (6, 14, 24)})
    stages += recursive(wu=("up", A14), wd=("down", A14), au=("up", A14, "up / 14"), ad=("down", A14, "down / 14"))
    stages.append({f"rsi_{n}": f"100 * {ratio(f'up{n}', f'up{n} + down{n}')}" for n in (6, 14, 24)} | {"rsi_wilder": f"100 * {ratio('wu', 'wu + wd')}", "rsi_adjusted": f"100 * {ratio('au', 'au + ad')}", "mean_up": f"au / (1 - power({1 - A14!r}, i + 1))"})
    return _stage("bars", *stages, keep="rsi_6 rsi_14 rsi_24 rsi_wilder rsi_adjusted mean_up")


def kdj() -> Stages:
    return _stage("bars", ROW | {"lo9": roll("min", "low", 9, 1), "hi9": roll("max", "high", 9, 1)}, {"rsv": f"coalesce(100 * {ratio('close - lo9', 'hi9 - lo9')}, 50.0)"}, *recursive(k=("rsv", 1 / 3)), *recursive(d=("k", 1 / 3)), {"j": "3 * k - 2 * d"}, keep="rsv k d j")


def bollinger() -> Stages:
    s = {"mid": roll("avg", "close", 20), "sd": roll("stddev_pop", "close", 20), "sd1": roll("stddev_samp", "close", 20)}
    return _stage("bars", s, {"boll_up": "mid + 2 * sd", "boll_low": "mid - 2 * sd"}, {"boll_pct": ratio("close - boll_low", "boll_up - boll_low"), "boll_width": ratio("boll_up - boll_low", "mid"), "boll_width_samp": ratio("4 * sd1", "mid")}, keep="boll_up boll_low boll_pct boll_width boll_width_samp")


def atr() -> Stages:
    return _stage("bars", PREV | ROW, {"tr": "greatest(high - low, abs(high - coalesce(pc, low)), abs(low - coalesce(pc, high)))"}, {"atr_14": roll("avg", "tr", 14)}, *recursive(atr_w=("tr", A14)), {"atr_pct": ratio("atr_14", "close"), "natr_14": f"100 * {ratio('atr_w', 'close')}"}, keep="tr atr_14 atr_pct natr_14")


def adx() -> Stages:
    first = PREV | {"ph": lag("high"), "pl": lag("low")}
    moves = {"u": "high - ph", "v": "pl - low", "tr": "greatest(high - low, abs(high - pc), abs(low - pc))"}
    dm = {"pdm": "(CASE WHEN u > v AND u > 0 THEN u ELSE 0.0 END)", "mdm": "(CASE WHEN v > u AND v > 0 THEN v ELSE 0.0 END)"}
    sums = {x: roll("avg", y, 14) for x, y in (("ap", "pdm"), ("am", "mdm"), ("avg_tr", "tr"))}
    di = {"pdi": f"100 * {ratio('ap', 'avg_tr')}", "mdi": f"100 * {ratio('am', 'avg_tr')}"}
    return _stage("bars", first, moves, dm, sums, di, {"dx": f"100 * {ratio('abs(pdi - mdi)', 'pdi + mdi')}"}, {"adx": roll("avg", "dx", 14)}, keep="pdi mdi adx")


def momentum() -> Stages:
    out = {f"roc_{n}": f"100 * ({ratio('close', lag('close', n))} - 1)" for n in (5, 10, 20, 60)}
    return _stage("bars", out, keep=" ".join(out))


def cci() -> Stages:
    mad = " + ".join(f"abs({lag('tp', k) if k else 'tp'} - m)" for k in range(14))
    return _stage("bars", {"tp": "(high + low + close) / 3"}, {"m": roll("avg", "tp", 14)}, {"mad": f"({mad}) / 14"}, {"cci_14": ratio("tp - m", "0.015 * mad")}, keep="cci_14")


def range_position() -> Stages:
    s = {f"lo{n}": roll("min", "low", n) for n in (14, 20, 60)} | {f"hi{n}": roll("max", "high", n) for n in (14, 20, 60)}
    below = " + ".join(f"{flag(f'{lag("close", k)} < close')} + {flag(f'{lag("close", k)} = close')} / 2" for k in range(1, 20))
    out = {"wr_14": f"-100 * {ratio('hi14 - close', 'hi14 - lo14')}", "rsv_20": ratio("close - lo20", "hi20 - lo20"), "channel_pos_60": ratio("close - lo60", "hi60 - lo60"), "rank_20": f"(CASE WHEN lo20 IS NOT NULL THEN (1 + {below}) / 20 END)"}
    return _stage("bars", s, out, keep=" ".join(out))


def mfi() -> Stages:
    return _stage("bars", {"tp": "(high + low + close) / 3"}, {"tp1": lag("tp")}, {"pos": "(CASE WHEN tp > tp1 THEN tp * vol ELSE 0.0 END)", "neg": "(CASE WHEN tp < tp1 THEN tp * vol ELSE 0.0 END)"}, {"sp": roll("sum", "pos", 14), "sn": roll("sum", "neg", 14)}, {"mfi_14": f"100 * {ratio('sp', 'sp + sn')}"}, keep="mfi_14")


def trix() -> Stages:
    e = [stage for k in range(3) for stage in recursive(**{f"e{k + 1}": (f"e{k}" if k else "close", A12)})]
    ma = {"f": roll("avg", "close", 12), "s": roll("avg", "close", 26)}
    return _stage("bars", ROW, *e, {"trix": f"100 * ({ratio('e3', lag('e3'))} - 1)"} | ma, {"apo": "f - s", "ppo": f"100 * {ratio('f - s', 's')}"}, keep="trix apo ppo")


def volume() -> Stages:
    s = PREV | {"vma_5": roll("avg", "vol", 5), "vma_20": roll("avg", "vol", 20), "vstd_20": roll("stddev_samp", "vol", 20), "ama": roll("avg", "amount", 20)}
    t = {"apct": f"abs({ratio('close', 'pc')} - 1)"}
    out = {"vol_ratio_5": ratio("vol", "vma_5"), "vol_ratio_20": ratio("vol", "vma_20"), "amount_ratio_20": ratio("amount", "ama"), "wvma_20": ratio(f"sum(apct * vol) {over(back(20))}", f"sum(apct) {over(back(20))}")}
    return _stage("bars", s, t, out, keep="vma_20 vstd_20 " + " ".join(out))


def candle_shape() -> Stages:
    r = "high - low"
    out = {"amplitude": ratio(r, "pc"), "kmid": ratio("close - open", "open"), "klen": ratio(r, "open"), "kmid2": ratio("close - open", r), "kup": ratio("high - greatest(open, close)", "open"), "kup2": ratio("high - greatest(open, close)", r), "klow": ratio("least(open, close) - low", "open"), "klow2": ratio("least(open, close) - low", r), "ksft": ratio("2 * close - high - low", "open"), "ksft2": ratio("2 * close - high - low", r), "gap_up": flag("low > ph"), "gap_down": flag("high < pl"), "bop": ratio("close - open", r)}
    return _stage("bars", PREV | {"ph": lag("high"), "pl": lag("low")}, out, keep=" ".join(out))


def volume_price() -> Stages:
    s = "(CASE WHEN close > pc AND vol > pv THEN 1 WHEN close > pc AND vol <= pv THEN 2 WHEN close < pc AND vol > pv THEN 3 WHEN close < pc AND vol <= pv THEN 4 ELSE 0 END)"
    return _stage("bars", PREV, {"vol_price_match": s}, keep="vol_price_match")


def on_balance() -> Stages:
    first = PREV | ROW | {"clv": f"coalesce({ratio('2 * close - high - low', 'high - low')}, 0.0) * vol"}
    sign = {"sv": "(CASE WHEN close > pc THEN vol WHEN close < pc THEN -vol ELSE 0.0 END)", "ad": running("sum", "clv")}
    return _stage("bars", first, sign, {"obv": running("sum", "sv")}, *recursive(e3=("ad", 2 / 11), e10=("ad", 2 / 21)), {"obv_diff_20": f"obv - {lag('obv', 20)}", "adosc": "e3 - e10"}, keep="obv ad obv_diff_20 adosc", digits=3)


def regression() -> Stages:
    s = {"lr_slope_20": roll2("regr_slope", "close", "i", 20), "lr_slope_60": roll2("regr_slope", "close", "i", 60), "lr_r2_60": roll2("regr_r2", "close", "i", 60), "su": roll("sum", "greatest(close - pc, 0.0)", 14), "sd": roll("sum", "greatest(pc - close, 0.0)", 14)}
    return _stage("bars", ROW | PREV, s, {"lr_angle_20": "degrees(atan(lr_slope_20))", "slope_pct_20": f"100 * {ratio('lr_slope_20', 'close')}", "rsi": f"100 * {ratio('su', 'su + sd')}"}, {"rsi_slope_5": roll2("regr_slope", "rsi", "i", 5)}, keep="lr_slope_20 lr_slope_60 lr_r2_60 lr_angle_20 slope_pct_20 rsi_slope_5")


def breakouts() -> Stages:
    s = {f"h{n}": f"max(high) {over(before(n))}" for n in (20, 60)} | {"l20": f"min(low) {over(before(20))}"}
    return _stage("bars", s, {"break_high_20": flag("close > h20"), "break_high_60": flag("close > h60"), "break_low_20": flag("close < l20")}, keep="break_high_20 break_high_60 break_low_20")


def _runs(cond: str, name: str) -> list[dict[str, str]]:
    """Consecutive rows up to this one for which `cond` holds."""
    return [{f"{name}_f": flag(cond)}, {f"{name}_b": running("sum", f"1 - {name}_f")}, {name: f"sum({name}_f) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', f'symbol, {name}_b')}"}]


def limit_runs(limit: float = 3.0) -> Stages:
    spike = {"volume_spike_up": flag(f"vol > 2 * {roll('avg', 'vol', 20)} AND pct > 0"), "volume_spike_dn": flag(f"vol > 2 * {roll('avg', 'vol', 20)} AND pct < 0")}
    return _stage("bars", PREV, PCT, {"limit_up": flag(f"100 * pct >= {limit}")} | spike, *_runs("limit_up > 0", "limit_consec"), keep="limit_up limit_consec volume_spike_up volume_spike_dn")


def quantile_bands() -> Stages:
    q = {"q8": f"percentile(close, 0.8) {over(back(20))}", "q2": f"percentile(close, 0.2) {over(back(20))}", "n": f"count(close) {over(back(20))}"}
    return _stage("bars", q, {"qtlu_20": f"(CASE WHEN n >= 20 THEN {ratio('q8', 'close')} - 1 END)", "qtld_20": f"(CASE WHEN n >= 20 THEN {ratio('q2', 'close')} - 1 END)"}, keep="qtlu_20 qtld_20")


def since_extremes() -> Stages:
    """Rows since the highest and the lowest close of 20 rows, the earliest of equals, and the rows between them."""
    f = over(back(20))
    s = {"hi": f"max_by(i, struct(close, -i)) {f}", "lo": f"max_by(i, struct(-close, -i)) {f}", "n": f"count(close) {f}"}
    return _stage("bars", ROW, s, {"imax_20": "(CASE WHEN n >= 20 THEN i - hi END)", "imin_20": "(CASE WHEN n >= 20 THEN i - lo END)", "imxd_20": "(CASE WHEN n >= 20 THEN hi - lo END)"}, keep="imax_20 imin_20 imxd_20")


def price_volume_corr() -> Stages:
    return _stage("bars", PREV, PCT | {"lv": "ln(1 + vol)", "dv": f"{ratio('vol', 'pv')} - 1"}, {"corr_close_vol_20": roll2("corr", "close", "lv", 20), "cord_ret_vol_20": roll2("corr", "pct", "dv", 20)}, keep="corr_close_vol_20 cord_ret_vol_20")


def up_down_counts() -> Stages:
    s = {"cntp_20": roll("avg", flag("pct > 0"), 20), "cntn_20": roll("avg", flag("pct < 0"), 20), "sp": roll("sum", "greatest(pct, 0.0)", 20), "sn": roll("sum", "greatest(-pct, 0.0)", 20)}
    return _stage("bars", PREV, PCT, s, {"cntd_20": "cntp_20 - cntn_20", "sump_20": ratio("sp", "sp + sn"), "sumn_20": ratio("sn", "sp + sn"), "sumd_20": ratio("sp - sn", "sp + sn")}, keep="cntp_20 cntn_20 cntd_20 sump_20 sumn_20 sumd_20")


def aroon() -> Stages:
    f = over(back(15))
    s = {"hi": f"max_by(i, struct(high, -i)) {f}", "lo": f"max_by(i, struct(-low, -i)) {f}", "n": f"count(close) {f}", "su": roll("sum", "greatest(close - pc, 0.0)", 14), "sd": roll("sum", "greatest(pc - close, 0.0)", 14)}
    out = {"aroon_up": "(CASE WHEN n >= 15 THEN 100 * (14 - (i - hi)) / 14 END)", "aroon_dn": "(CASE WHEN n >= 15 THEN 100 * (14 - (i - lo)) / 14 END)", "rsi": f"round(100 * {ratio('su', 'su + sd')}, 9)"}
    stoch = {"stochrsi_k": f"100 * {ratio('rsi - ' + roll('min', 'rsi', 14), roll('max', 'rsi', 14) + ' - ' + roll('min', 'rsi', 14))}"}
    return _stage("bars", ROW | PREV, s, out, {"aroon_osc": "aroon_up - aroon_dn", "cmo_14": f"100 * {ratio('su - sd', 'su + sd')}"} | stoch, {"stochrsi_d": roll("avg", "stochrsi_k", 3)}, keep="aroon_up aroon_dn aroon_osc cmo_14 stochrsi_k stochrsi_d")


def heikin_ashi() -> Stages:
    """ha_open is the mean of the bar before's ha_open and ha_close: a recursive mean of weight a half, re-based every 512 rows."""
    terms = " + ".join(f"coalesce({lag('hc', k)}, 0.0) * {0.5 ** k!r}" for k in range(1, 41))
    first = f"first_value((open + close) / 2) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"
    return _stage("bars", ROW | {"hc": "(open + high + low + close) / 4", "o0": first}, {"ha_open": f"{terms} + power(0.5, i) * o0"}, {"ha_close": "hc", "ha_high": "greatest(high, ha_open, hc)", "ha_low": "least(low, ha_open, hc)"}, keep="ha_open ha_close ha_high ha_low")


NET = {f"{n}_net": f"(buy_{t}_amount - sell_{t}_amount) / 1e5" for n, t in (("sm", "sm"), ("mid", "md"), ("lg", "lg"), ("elg", "elg"))}
MAIN = {"main_net": "lg_net + elg_net"}


def flow_sums() -> Stages:
    out = {f"{t}_net_{n}d": roll("sum", f"{t}_net", n, k) for t in ("sm", "mid", "lg", "elg", "main") for n, k in ((5, 3), (20, 10))}
    return _stage("flow", NET, MAIN, out, keep=" ".join(out))


def flow_balance() -> Stages:
    buy, sell = (" + ".join(f"{s}_{t}_amount" for t in ("sm", "md", "lg", "elg")) for s in ("buy", "sell"))
    s = {"m5": roll("sum", "main_net", 5, 3), "e5": roll("sum", "elg_net", 5, 3), "r5": roll("sum", "sm_net", 5, 3), "imb": ratio(f"({buy}) - ({sell})", f"({buy}) + ({sell})")}
    return _stage("flow", NET, MAIN, s, {"dispersion_5d": "coalesce(sign(m5), 0) - coalesce(sign(r5), 0)", "elg_ratio_5d": clip(ratio("e5", "abs(m5) + 0.001"), -2.0, 3.0), "buy_sell_imb_5d": roll("avg", "imb", 5, 3)}, keep="dispersion_5d elg_ratio_5d buy_sell_imb_5d")


def flow_events() -> Stages:
    first = NET | PREV
    s = MAIN | PCT
    t = {"f1": roll("sum", "(CASE WHEN pct < 0 AND main_net > 0 THEN main_net ELSE 0.0 END)", 20, 10), "f2": roll("sum", "(CASE WHEN pct > 0 AND main_net < 0 THEN -main_net ELSE 0.0 END)", 20, 10), "f3": roll("sum", "(CASE WHEN pct > 0.02 AND main_net > 0 THEN main_net ELSE 0.0 END)", 20, 10), "f4": "(sign(main_net) - sign(sm_net)) * pct", "f6": ratio("main_net", f"avg(amount) {over(back(20))} / 1e5")}
    return _stage("panel_flow", first, s, t, {"f5": f"(CASE WHEN count(main_net) {over(back(60))} >= 20 THEN ({' + '.join(flag(f'{lag('main_net', k)} < main_net') for k in range(1, 60))}) / (count(main_net) {over(back(60))} - 1) END)"}, *_runs("main_net > 0 AND abs(pct) < 0.01", "f7"), *_runs("main_net < 0 AND abs(pct) < 0.01", "f8"), keep="f1 f2 f3 f4 f5 f6 f7 f8")


def flow_runs() -> Stages:
    return _stage("flow", NET, MAIN, *_runs("main_net > 0", "consec_in"), *_runs("main_net < 0", "consec_out"), keep="consec_in consec_out")


def flow_trend() -> Stages:
    """Means and their crossing, MACD with zero distance, RSI spread of large and small flow, pyramid, velocity, correlations with the price (also led by five rows), rank in 60 rows; all on net flow."""
    s = {"mfk_ma5": roll("avg", "main_net", 5, 3), "mfk_ma20": roll("avg", "main_net", 20, 10)} | {f"{k}{w}": roll("sum", f"greatest({'' if w == 'u' else '-'}{n}, 0.0)", 14) for k, n in (("m", "main_net"), ("s", "sm_net")) for w in ("u", "d")}
    u = {"mfk_diff": "mfk_ma5 - mfk_ma20", "mfk_macd": "e12 - e26", "mfk_sync": roll2("corr", "main_net", "pct", 20), "mfk_lead5": roll2("corr", "m5", "pct", 20), "mfk_velocity": "main_net - m5", "mfk_spread": f"100 * {ratio('mu', 'mu + md')} - 100 * {ratio('su', 'su + sd')}", "mfk_pyramid": ratio("elg_net - sm_net", "abs(elg_net) + abs(lg_net) + abs(mid_net) + abs(sm_net)"), "mfk_zero_dist": ratio("e12 - e26", "abs(e12) + abs(e26)")}
    less = " + ".join(flag(f"{lag('main_net', k)} < main_net") for k in range(1, 60))
    cross = {"mfk_cross": f"(CASE WHEN mfk_diff > 0 AND {lag('mfk_diff')} <= 0 THEN 1 WHEN mfk_diff <= 0 AND {lag('mfk_diff')} > 0 THEN -1 ELSE 0 END)", "mfk_strength": ratio("mfk_diff", "abs(mfk_ma20) + 0.001"), "mfk_rank60": f"(CASE WHEN count(main_net) {over(back(60))} >= 20 THEN ({less}) / (count(main_net) {over(back(60))} - 1) END)"}
    return _stage("panel_flow", NET | PREV | ROW, MAIN | PCT, {"m5": lag("main_net", 5)}, *recursive(e12=("main_net", A12), e26=("main_net", A26)), s, u, *recursive(mfk_signal=("mfk_macd", A9)), *_runs("mfk_diff > 0", "mfk_days_above"), {"mfk_hist": "mfk_macd - mfk_signal"} | cross, keep="mfk_ma5 mfk_ma20 mfk_diff mfk_cross mfk_strength mfk_macd mfk_signal mfk_hist mfk_zero_dist mfk_spread mfk_pyramid mfk_sync mfk_lead5 mfk_velocity mfk_rank60 mfk_days_above")


def pyramid() -> Stages:
    s = {f"p{n}": ratio(f"sum(main_net) {over(back(n))}", f"abs(sum(sm_net) {over(back(n))}) + 0.001") for n in (5, 10, 20, 30, 60)}
    speed = {f"pyr_velocity_{a}_{b}": f"pyr_{a}d - pyr_{b}d" for a, b in ((10, 60), (5, 60), (10, 30), (20, 60), (5, 30))}
    return _stage("flow", NET, MAIN, s, {f"pyr_{n}d": clip(f"p{n}", -100.0, 100.0) for n in (5, 10, 20, 30, 60)}, {"pyr_acc_5_20": "pyr_5d - pyr_20d"} | speed, keep="pyr_5d pyr_10d pyr_20d pyr_60d pyr_acc_5_20 " + " ".join(speed))


def flow_thresholds() -> Stages:
    out = {f"f1_neg{k}": roll("sum", f"(CASE WHEN pct < -{k / 100} AND main_net > 0 THEN main_net ELSE 0.0 END)", 20, 10) for k in (1, 5, 8)}
    out |= {f"f2_pos{k}": roll("sum", f"(CASE WHEN pct > {k / 100} AND main_net < 0 THEN -main_net ELSE 0.0 END)", 20, 10) for k in (1, 5, 8)}
    return _stage("panel_flow", NET | PREV, MAIN | PCT, out, keep=" ".join(out))


def impact() -> Stages:
    a = "(amount / 1e8)"
    s = {"upward_impact": roll("sum", f"(CASE WHEN pct > 0 THEN {ratio('pct', a)} ELSE 0.0 END)", 5, 3), "range_per_amount": roll("avg", ratio("(high - low) / low", a), 5, 3), "amihud_illiq_5d": roll("avg", ratio("abs(pct)", a), 5, 3), "kyle_lambda_20d": roll2("corr", "pct", "amount", 20), "tail_risk_5d": roll("min", "pct", 5, 3), "range_compression": ratio(roll("avg", "high - low", 5), roll("avg", "high - low", 20)), "dd": f"{ratio('close', f'max(high) {over(back(20))}')} - 1", "iu": roll("avg", f"(CASE WHEN pct > 0 THEN {ratio('pct', a)} END)", 20, 5), "id": roll("avg", f"(CASE WHEN pct < 0 THEN {ratio('-pct', a)} END)", 20, 5)}
    return _stage("bars", PREV, PCT, s, {"drawdown_recovery": f"dd - {lag('dd', 5)}", "price_impact_asym": "iu - id"}, keep="upward_impact range_per_amount amihud_illiq_5d kyle_lambda_20d tail_risk_5d range_compression drawdown_recovery price_impact_asym")


def amount() -> Stages:
    s = {"amount_5d": roll("avg", "amount", 5), "amount_20d": roll("avg", "amount", 20), "amount_log": "ln(1 + amount)", "m60": roll("avg", "amount", 60, 20), "s60": roll("stddev_samp", "amount", 60, 20)}
    return _stage("bars", s, {"amount_z60": ratio("amount - m60", "s60"), "amount_breakout": flag(f"amount > max(amount) {over(before(20))}")}, keep="amount_5d amount_20d amount_log amount_z60 amount_breakout")


def market_regime() -> Stages:
    s = PREV | {f"ret_{n}": f"{ratio('close', lag('close', n))} - 1" for n in (5, 20, 60)} | {"ma60": roll("avg", "close", 60), "mid": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20), "vol_ratio": ratio("vol", roll("avg", "vol", 20)), "vm": roll("avg", "vol", 60), "vs": roll("stddev_samp", "vol", 60)}
    t = PCT | {"ma60_slope": f"{ratio('ma60', lag('ma60', 20))} - 1", "boll_width": ratio("4 * sd", "mid"), "vol_z60": ratio("vol - vm", "vs")}
    t |= {"gains": roll("sum", "greatest(close - pc, 0.0)", 14), "losses": roll("sum", "greatest(pc - close, 0.0)", 14)}
    u = {"sigma_20": roll("stddev_samp", "pct", 20), "rsi_14": f"100 * {ratio('gains', 'gains + losses')}"}
    c = {"regime": "(CASE WHEN ret_60 IS NULL OR ma60_slope IS NULL THEN 0 WHEN ret_20 > 0.02 AND ma60_slope > 0 THEN 1 WHEN ret_20 > 0 THEN 2 WHEN ret_20 < -0.02 AND ma60_slope < 0 THEN 3 WHEN ret_20 < 0 THEN 4 ELSE 5 END)"}
    return _stage("market", s, t, u, c, keep="ret_5 ret_20 ret_60 ma60_slope boll_width vol_ratio vol_z60 sigma_20 rsi_14 regime")


def regime_spells() -> Stages:
    base = market_regime()
    change = {"c": f"(CASE WHEN regime = {lag('regime')} THEN 0 ELSE 1 END)"}
    days = {"regime_days_in": f"row_number() {over(key='symbol, block')} - 1", "intensity": f"sum(ret_5) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', 'symbol, block')}", "z": ratio(f"ret_60 - avg(ret_60) {over(back(120))}", f"stddev_samp(ret_60) {over(back(120))}")}
    return _stage("market", *base.stages, change, {"block": running("sum", "c")}, days, keep="regime block regime_days_in intensity z")


def zombie() -> Stages:
    return _stage("bars", {"ma60": roll("avg", "close", 60, 30)}, {"near": f"(CASE WHEN ma60 IS NULL THEN NULL WHEN abs({ratio('close', 'ma60')} - 1) <= 0.05 THEN 1.0 ELSE 0.0 END)", "ma60_slope": f"{ratio('ma60', lag('ma60', 20))} - 1"}, {"zombie_share": roll("avg", "near", 20, 10)}, {"is_zombie": flag("zombie_share >= 0.5 AND abs(ma60_slope) < 0.005")}, keep="zombie_share ma60_slope is_zombie")


def price_channel() -> Stages:
    return _stage("bars", ROW | {"h": roll("max", "high", 100, 20), "l": roll("min", "low", 100, 20)}, {"upper": wma("h", 60), "lower": wma("l", 60)}, {"mid": "(upper + lower) / 2", "width": ratio("upper - lower", "lower"), "place": ratio("close - lower", "upper - lower")}, keep="upper lower mid width place")


def ichimoku() -> Stages:
    half = lambda n: f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"
    return _stage("bars", {"tenkan": half(9), "kijun": half(26), "span_b": half(52)}, {"span_a": "(tenkan + kijun) / 2"}, {"cloud": "(CASE WHEN span_a IS NULL OR span_b IS NULL THEN NULL WHEN close > greatest(span_a, span_b) THEN 1 WHEN close < least(span_a, span_b) THEN -1 ELSE 0 END)"}, keep="tenkan kijun span_a span_b cloud")


def quant_alpha() -> Stages:
    s = PREV | {"tr": "high - low"}
    t = PCT | {"a5": roll("avg", "tr", 5), "a20": roll("avg", "tr", 20), "h60": roll("max", "high", 60)}
    u = {"avg_amount_20": roll("avg", "amount", 20), "amount_ratio": ratio("amount", roll("avg", "amount", 20)), "atr_convergence": ratio("a5", "a20"), "near_high_60": ratio("close", "h60"), "volatility_20": f"{roll('stddev_samp', 'pct', 20)} * sqrt(252)", "volume_ratio_5_20": ratio(roll("avg", "vol", 5), roll("avg", "vol", 20))}
    return _stage("bars", s, t, u, keep=" ".join(u))


def ma_system() -> Stages:
    out = {f"ma_{n}": roll("avg", "close", n) for n in (5, 10, 20, 30, 60, 120, 250)} | {"amplitude_20": ratio(roll("max", "high", 20), roll("min", "low", 20)), "shadow_5": roll("avg", ratio("high - greatest(open, close)", "high - low"), 5, 1)}
    return _stage("bars", out, keep=" ".join(out))


def relative_strength() -> Stages:
    """Needs a column `peer`, the benchmark's close."""
    s = {"rs": ratio("close", "peer")}
    t = {"rs_ma20": roll("avg", "rs", 20), "rs_mom_10": f"{ratio('rs', lag('rs', 10))} - 1", "excess_20": f"{ratio('close', lag('close', 20))} - {ratio('peer', lag('peer', 20))}", "rs_high_60": flag(f"rs >= max(rs) {over(back(60))}"), "rs_low_60": flag(f"rs <= min(rs) {over(back(60))}")}
    t["peer_high_60"] = flag(f"close >= max(close) {over(back(60))}")
    return _stage("with_peer", s, t, {"rs_divergence": "(CASE WHEN peer_high_60 > 0 AND rs_high_60 = 0 THEN -1 WHEN peer_high_60 = 0 AND rs_high_60 > 0 THEN 1 ELSE 0 END)", "rs_trend": "(CASE WHEN rs > rs_ma20 THEN 1 WHEN rs < rs_ma20 THEN -1 ELSE 0 END)"}, keep="rs rs_ma20 rs_mom_10 excess_20 rs_high_60 rs_low_60 rs_divergence rs_trend")


def hourly_signals() -> Stages:
    s = PREV | {"ma5": roll("avg", "close", 5), "ma20": roll("avg", "close", 20), "v3": roll("avg", "vol", 3), "v20": roll("avg", "vol", 20)}
    t = {"slope_5": f"{ratio('ma5', lag('ma5', 3))} - 1", "above": flag("ma5 > ma20"), "volume_3_20": ratio("v3", "v20"), "su": roll("sum", "greatest(close - pc, 0.0)", 14), "sd": roll("sum", "greatest(pc - close, 0.0)", 14)}
    return _stage("bars", s, t, {"rsi_14": f"100 * {ratio('su', 'su + sd')}", "intraday_score": f"50 + 15 * (2 * above - 1) + {clip('slope_5 * 1000', -15.0, 15.0)} + {clip('(volume_3_20 - 1) * 10', -10.0, 10.0)}"}, keep="slope_5 above volume_3_20 rsi_14 intraday_score")


def own_percentile() -> Stages:
    """Share of the 120 rows before that are strictly below, from 10 rows on."""
    less = " + ".join(flag(f"{lag('vol', k)} < vol") for k in range(1, 121))
    return _stage("bars", {"n": f"count(vol) {over(before(120))}"}, {"percentile_own": f"(CASE WHEN n >= 10 THEN ({less}) / n END)"}, keep="percentile_own")


def score_shape() -> Stages:
    s = {"score": f"100 * {ratio('close - low', 'high - low')}"}
    t = {"p1": lag("score"), "p2": lag("score", 2)}
    return _stage("bars", s, t, {"delta": "score - p1", "shape": "(CASE WHEN p2 IS NULL OR score IS NULL THEN 0 WHEN score > p1 AND p1 > p2 THEN 1 WHEN score < p1 AND p1 < p2 THEN 2 WHEN score > p1 AND p1 < p2 THEN 3 WHEN score < p1 AND p1 > p2 THEN 4 ELSE 5 END)"}, keep="score delta shape")


def continuity() -> Stages:
    return _stage("bars", PREV | {"ph": lag("high"), "pl": lag("low")}, *_runs("close > open", "bull"), *_runs("close < open", "bear"), *_runs("high > ph", "higher_highs"), *_runs("low < pl", "lower_lows"), {"gaps_5": roll("sum", flag("low > ph OR high < pl"), 5, 1), "body_trend": roll("avg", "abs(close - open)", 3, 1)}, keep="bull bear higher_highs lower_lows gaps_5 body_trend")


def adjacency() -> Stages:
    p = {f"p_{c}": lag(c) for c in ("open", "high", "low", "close")}
    out = {"gap_pct": f"100 * ({ratio('open', 'p_close')} - 1)", "high_change": f"100 * ({ratio('high', 'p_high')} - 1)", "low_change": f"100 * ({ratio('low', 'p_low')} - 1)", "body_overlap": ratio("greatest(0.0, least(greatest(open, close), greatest(p_open, p_close)) - greatest(least(open, close), least(p_open, p_close)))", "abs(p_close - p_open)"), "engulf": ratio("abs(close - open)", "abs(p_close - p_open)")}
    return _stage("bars", p, out, keep=" ".join(out))


def fibonacci() -> Stages:
    s = {"hi": roll("max", "high", 60), "lo": roll("min", "low", 60)}
    out = {f"fib_{round(1000 * r)}": f"hi - {r} * (hi - lo)" for r in (0.236, 0.382, 0.5, 0.618, 0.786)} | {"fib_ext_1272": "hi + 0.272 * (hi - lo)", "fib_ext_1618": "hi + 0.618 * (hi - lo)"}
    return _stage("bars", s, out, keep=" ".join(out))


def flow_snapshot() -> Stages:
    s = {"mf3": roll("avg", "main_net", 3, 1), "r3": roll("avg", "sm_net", 3, 1), "up3": roll("sum", flag("main_net > 0"), 3, 1)}
    return _stage("flow", NET, MAIN, s, {"direction": "(CASE WHEN up3 >= 2 THEN 1 ELSE -1 END)", "divergence": "(CASE WHEN mf3 > 0 AND r3 < 0 THEN 8 WHEN mf3 > 0 THEN 3 WHEN mf3 < 0 AND r3 > 0 THEN -12 WHEN mf3 < 0 THEN -5 ELSE 0 END)"}, *_runs("main_net > 0", "days_in"), keep="mf3 direction divergence days_in")


def report_change() -> Stages:
    out = {f"change_{n}": f"100 * ({ratio('amount', lag('amount', n))} - 1)" for n in (1, 4, 12)}
    return _stage("bars", out, keep=" ".join(out))


FEATURES = {
    "w01_moving_averages": moving_averages, "w02_macd": macd, "w03_rsi": rsi, "w04_kdj": kdj, "w05_bollinger": bollinger, "w06_atr": atr, "w07_adx": adx, "w08_momentum": momentum, "w09_cci": cci,
    "w10_range_position": range_position, "w11_mfi": mfi, "w12_trix": trix, "w13_volume": volume, "w14_candle_shape": candle_shape, "w15_volume_price": volume_price, "w16_on_balance": on_balance,
    "w17_regression": regression, "w18_breakouts": breakouts, "w19_limit_runs": limit_runs, "w20_quantile_bands": quantile_bands, "w21_since_extremes": since_extremes, "w22_price_volume_corr": price_volume_corr,
    "w23_up_down_counts": up_down_counts, "w24_aroon": aroon, "w26_heikin_ashi": heikin_ashi, "w27_flow_sums": flow_sums, "w28_flow_balance": flow_balance, "w29_flow_events": flow_events, "w30_flow_runs": flow_runs,
    "w31_flow_trend": flow_trend, "w32_pyramid": pyramid, "w33_flow_thresholds": flow_thresholds, "w34_impact": impact, "w35_amount": amount, "w36_market_regime": market_regime, "w37_regime_spells": regime_spells,
    "w38_zombie": zombie, "w39_price_channel": price_channel, "w40_ichimoku": ichimoku, "w41_quant_alpha": quant_alpha, "w43_relative_strength": relative_strength, "w45_ma_system": ma_system, "w47_hourly_signals": hourly_signals,
    "w48_own_percentile": own_percentile, "w49_score_shape": score_shape, "w51_continuity": continuity, "w52_adjacency": adjacency, "w53_fibonacci": fibonacci, "w54_flow_snapshot": flow_snapshot, "w56_report_change": report_change,
}
