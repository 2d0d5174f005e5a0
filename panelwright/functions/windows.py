"""Builders of window expressions in ANSI SQL text, valid as Spark expressions (`F.expr`).

All frames are row-ordinal over one (symbol, date) window, so Spark plans any number of them as
one exchange, one sort and one Window node. `min_rows` gives NULL until that many values are there.
"""
from __future__ import annotations

import math

KEY, ORDER = "symbol", "trade_date"


def over(frame: str = "", key: str | None = KEY, order: str | None = ORDER) -> str:
    parts = [f"PARTITION BY {key}" if key else "", f"ORDER BY {order}" if order else "", frame]
    return f"OVER ({' '.join(p for p in parts if p)})"


def back(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def before(n: int) -> str:
    return f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


def ahead(n: int) -> str:
    return f"ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING"


RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def roll(agg: str, x: str, n: int, min_rows: int | None = None, frame: str | None = None) -> str:
    """`agg(x)` over the last n rows, NULL with fewer than min_rows (default n) values."""
    f = over(frame or back(n))
    return f"(CASE WHEN count({x}) {f} >= {n if min_rows is None else min_rows} THEN {agg}({x}) {f} END)"


def roll2(agg: str, y: str, x: str, n: int) -> str:
    """A two-argument aggregate over the last n rows, NULL until n rows have both."""
    f = over(back(n))
    if agg == "corr":  # which fails on a constant input; null here
        value = f"covar_pop({y}, {x}) {f} / nullif(round(stddev_pop({y}) {f} * stddev_pop({x}) {f}, 12), 0)"
    else:
        value = f"{agg}({y}, {x}) {f}"
    return f"(CASE WHEN count({y} + {x}) {f} >= {n} THEN {value} END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {over()}"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) {over()}"


def running(agg: str, x: str) -> str:
    return f"{agg}({x}) {over(RUN)}"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def recursive(start: int = 0, **means: tuple) -> list[dict[str, str]]:
    """Stages that add recursive means y = (1 - a) y + a x, one for each name = (x, a) or (x, a, seed); needs the row number `i`.

    The first value, at row `start`, is x or the seed (SQL text); null before it. A key's rows are taken in blocks so
    short that (1 - a)**-rows stays below 1e18: inside a block a scaled running sum, plus
    the last value of the block before it, decayed. What is older than two blocks weighs
    under 1e-18 and is left out, so keys may have any number of rows.
    """
    blocks, sums, out = {}, {}, {}
    for name, (x, a, *seed) in means.items():
        d = 1 - a
        rows = math.ceil(math.log(1e18) / -math.log(d))
        i = f"(i - {start})" if start else "i"
        at = f"({i} - {name}_b * {rows})"
        first = seed[0] if seed else x
        blocks[f"{name}_b"] = f"CAST(floor({i} / {rows}) AS INTEGER)"
        scaled = f"(CASE WHEN {i} < 0 THEN NULL WHEN {i} = 0 THEN {first} ELSE {a!r} * ({x}) * power({d!r}, -{at}) END)"
        sums[f"{name}_l"] = f"(power({d!r}, {at}) * sum({scaled}) {over(RUN, f'{KEY}, {name}_b')})"
        last = f"max_by({name}_l, i) {over('RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING', order=f'{name}_b')}"
        out[name] = f"({name}_l + coalesce({last}, 0.0) * power({d!r}, {at} + 1))"
    return [blocks, sums, out]


def wma(x: str, n: int, row: str = "i") -> str:
    """Linearly weighted mean, the newest row with weight n."""
    f = over(back(n))
    return f"(CASE WHEN count({x}) {f} >= {n} THEN (sum(({x}) * {row}) {f} - ({row} - {n}) * sum({x}) {f}) / {n * (n + 1) / 2} END)"


def flag(cond: str) -> str:
    """1.0 or 0.0; an unknown condition is 0.0."""
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def run_block(cond_key: str) -> str:
    """Number of a run of equal values of `cond_key`, whose change is flagged in the column of that name."""
    return running("sum", cond_key)


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) < {lo} THEN {lo} WHEN ({x}) > {hi} THEN {hi} ELSE ({x}) END)"
