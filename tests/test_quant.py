"""Every rung of every ladder of the quant score, its limits and its gaps."""
from pyspark.sql import functions as F

from panelwright.operators import quant

COLUMNS = ("adx", "pdi", "mdi", "winner_rate", "divergence", "main_rate_ma3", "main_net_ma3", "main_days", "holder_pct", "mv", "ma_ratio_60", "mfi", "rsi_24", "trix", "pe", "atr_pct")
#: (columns, factor, step); no step where it is 0.
RUNGS = [
    ({"adx": 30, "pdi": 30, "mdi": 10}, "adx", 10), ({"adx": 25, "pdi": 30, "mdi": 10}, "adx", 6), ({"adx": 29.9, "pdi": 10, "mdi": 30}, "adx", -8), ({"adx": 35, "pdi": 10, "mdi": 10}, "adx", -8), ({"adx": 19, "pdi": 30, "mdi": 10}, "adx", -2), ({"adx": 19, "pdi": 3, "mdi": 10}, "adx", -2), ({"adx": 20, "pdi": 30, "mdi": 10}, "", 0), ({"adx": 40, "pdi": None, "mdi": 10}, "", 0),
    ({"winner_rate": 20}, "winner_rate", 12), ({"winner_rate": 35}, "winner_rate", 6), ({"winner_rate": 36}, "", 0), ({"winner_rate": 75}, "winner_rate", -5), ({"winner_rate": 85}, "winner_rate", -10),
    ({"divergence": "distribution"}, "mf_divergence", -12), ({"divergence": "smart_accumulating"}, "mf_divergence", 8), ({"divergence": "consensus_buy"}, "mf_divergence", 3), ({"divergence": "consensus_sell"}, "mf_divergence", -5), ({"divergence": "neutral"}, "", 0),
    ({"main_rate_ma3": 3, "main_net_ma3": -9e9}, "mf_strength", 10), ({"main_rate_ma3": 1}, "mf_strength", 5), ({"main_rate_ma3": 0.5, "main_net_ma3": 9e9}, "", 0), ({"main_rate_ma3": -1}, "mf_strength", -5), ({"main_rate_ma3": -3}, "mf_strength", -10),
    ({"main_net_ma3": 5000}, "mf_strength", 10), ({"main_net_ma3": 1000}, "mf_strength", 5), ({"main_net_ma3": -1000}, "mf_strength", -5), ({"main_net_ma3": -5000}, "mf_strength", -10), ({"main_net_ma3": 10}, "", 0),
    ({"main_days": 5}, "mf_consecutive", 5), ({"main_days": 3}, "mf_consecutive", 3), ({"main_days": 2}, "", 0),
    ({"holder_pct": -5}, "holders", 8), ({"holder_pct": -2}, "holders", 4), ({"holder_pct": 0}, "", 0), ({"holder_pct": 2}, "holders", -3), ({"holder_pct": 5}, "holders", -6), ({"holder_pct": 501}, "", 0), ({"holder_pct": 500}, "holders", -6),
    ({"mv": 99, "ma_ratio_60": -0.05}, "layer_ma_ratio60", 6), ({"mv": 99, "ma_ratio_60": 0.11}, "layer_ma_ratio60", -6), ({"mv": 99, "ma_ratio_60": 0.05}, "layer_ma_ratio60", -3), ({"mv": 99, "ma_ratio_60": 0.04}, "", 0), ({"mv": 100, "ma_ratio_60": 0.5}, "", 0), ({"mv": 1000, "ma_ratio_60": 0.05}, "layer_ma_ratio60", 5), ({"mv": 1000, "ma_ratio_60": -0.05}, "layer_ma_ratio60", -3), ({"ma_ratio_60": -0.05}, "", 0),
    ({"mv": 300, "mfi": 75}, "layer_mfi", 5), ({"mv": 300, "mfi": 60}, "layer_mfi", 3), ({"mv": 99, "mfi": 80}, "layer_mfi", -3), ({"mv": 99, "mfi": 79}, "", 0), ({"mv": 200, "mfi": 90}, "", 0),
    ({"mv": 1000, "rsi_24": 65}, "layer_rsi24", 4), ({"mv": 1000, "rsi_24": 55}, "layer_rsi24", 2), ({"mv": 1000, "rsi_24": 35}, "layer_rsi24", -2), ({"mv": 999, "rsi_24": 65}, "", 0),
    ({"mv": 50, "trix": 0.6}, "layer_trix", -3), ({"mv": 50, "trix": -0.6}, "layer_trix", 3), ({"mv": 50, "trix": 0.5}, "", 0), ({"mv": 100, "trix": 0.6}, "", 0),
    ({"pe": 10, "atr_pct": 0.041}, "layer_pe_atr", 2), ({"pe": 0, "atr_pct": 0.09}, "", 0), ({"pe": 15, "atr_pct": 0.09}, "", 0), ({"pe": -1, "atr_pct": 0.051}, "layer_pe_atr", -4), ({"pe": 100, "atr_pct": 0.051}, "layer_pe_atr", -4), ({"pe": 100, "atr_pct": 0.05}, "", 0),
]


def run(spark, rows, **kw):
    schema = "i int, " + ", ".join(f"{c} {'string' if c == 'divergence' else 'double'}" for c in COLUMNS)
    table = [(i, *(x.get(c) if c == "divergence" or x.get(c) is None else float(x[c]) for c in COLUMNS)) for i, x in enumerate(rows)]
    return quant.quant_score(spark.createDataFrame(table, schema), keys=("i",), **kw).orderBy("i").collect()


def test_every_rung(spark):
    for (columns, factor, step), r in zip(RUNGS, run(spark, [x for x, *_ in RUNGS])):
        assert [(a.factor, a.delta) for a in r.adjustments] == ([(factor, step)] if step else []), columns
        assert (r.score, r.total) == (50 + step, step)
    every = {(name, delta) for name, rungs in quant.ladders().items() for _, delta in rungs}
    assert every == {(f, s) for _, f, s in RUNGS if s}


def test_sum_limits_and_no_data(spark):
    best = {"adx": 40, "pdi": 2, "mdi": 1, "winner_rate": 5, "divergence": "smart_accumulating", "main_rate_ma3": 9, "main_days": 9, "holder_pct": -9, "mv": 1000, "ma_ratio_60": 0.2, "mfi": 90, "rsi_24": 90, "pe": 10, "atr_pct": 0.05}
    top, none = run(spark, [best, {}])
    assert (top.score, top.total) == (100, 10 + 12 + 8 + 10 + 5 + 8 + 5 + 5 + 4 + 2) and (none.score, none.total, none.adjustments) == (50, 0, [])
    assert run(spark, [{"mv": 50, "ma_ratio_60": -0.03}], moves=0.5)[0].total == 6


def test_as_of_takes_the_latest_known_report(spark):
    from panelwright.operators import panels as P

    left = spark.sql("SELECT 'A' AS symbol, explode(sequence(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 20 DAYS)) AS trade_date")
    right = spark.createDataFrame([("A", "2024-01-21", 1.0), ("A", "2024-02-20", 2.0), ("B", "2024-01-01", 9.0)], "symbol string, d string, x double").select("symbol", F.to_date("d").alias("trade_date"), "x")
    assert [r.x for r in P.as_of(left, right, ["x"]).orderBy("trade_date").collect()] == [None, 1.0, 1.0, 2.0]
