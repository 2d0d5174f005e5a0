"""An operator as named stages of column expressions, with one text for Spark and for the SQL that checks it."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Functions that DuckDB names differently.
DIALECT = {"percentile(": "quantile_cont(", "struct(": "row(", "max_by(": "arg_max("}


@dataclass(frozen=True)
class Stages:
    """Each stage adds columns computed from those before it; `keep` (with `keys`) is returned, doubles rounded to `digits`."""

    source: str
    stages: tuple[dict[str, str], ...]
    keep: tuple[str, ...]
    keys: tuple[str, ...] = ("symbol", "trade_date")
    where: str = ""
    digits: int = 6

    def columns(self) -> list[str]:
        return [*self.keys, *(f"{rounded(c, self.digits)} AS {c}" for c in self.keep)]

    def apply(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = df.select("*", *(F.expr(doubles(x)).alias(c) for c, x in stage.items()))
        if self.where:
            df = df.where(doubles(self.where))
        return df.selectExpr(*self.columns())

    def sql(self, source: str) -> str:
        """The same over a relation named `source`."""
        at = source
        ctes = []
        for k, stage in enumerate(self.stages):
            ctes.append(f"s{k} AS (SELECT *, {', '.join(f'{duck(x)} AS {c}' for c, x in stage.items())} FROM {at})")
            at = f"s{k}"
        where = f" WHERE {duck(self.where)}" if self.where else ""
        return (",\n".join(ctes) + "\n" if ctes else "") + f"SELECT {', '.join(self.columns())} FROM {at}{where}"


def doubles(x: str) -> str:
    """Decimal literals as doubles: 0.5 is a decimal in SQL, 0.5e0 a double."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", x)


def rounded(c: str, digits: int) -> str:
    """Rounded, ties upwards even if the last bits of `c` depend on the order of summation."""
    return f"round(CAST({c} AS DOUBLE) + 3e-{digits + 3}, {digits})"


def duck(x: str) -> str:
    x = doubles(x)
    for a, b in DIALECT.items():
        x = x.replace(a, b)
    return x
