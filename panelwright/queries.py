"""The registered queries of the panel operators and, for each, SQL that gives the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decision_queries, frame_queries, further_queries, layer_queries, live_queries, model_queries, more_queries, panel_queries, quant_queries, relation_queries, score_queries, segment_queries, shape_queries, source_queries, table_queries  # noqa: F401  (the others register with panel_queries)
from .operators.features import FEATURES
from .operators.scores import SCORES
from .operators.spec import Stages
from .sources.fixtures import CTES, TABLES

Query = Callable[[SparkSession, str], DataFrame]


def with_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the market's close as `peer`, aligned by date."""
    peer = TABLES["market"](spark, sf_dir).selectExpr("trade_date", "close AS peer")
    return TABLES["bars"](spark, sf_dir).join(peer, "trade_date")


SOURCES: dict[str, Query] = TABLES | {"with_peer": with_peer}
SOURCE_SQL = CTES | {"with_peer": CTES["market"] + ",\nwith_peer AS (SELECT bars.*, market.close AS peer FROM bars JOIN market USING (trade_date))"}


def _query(spec: Stages) -> Query:
    return lambda spark, sf_dir: spec.apply(SOURCES[spec.source](spark, sf_dir))


def _sql(spec: Stages) -> str:
    return f"WITH {SOURCE_SQL[spec.source]},\n{spec.sql(spec.source)}" if spec.stages else f"WITH {SOURCE_SQL[spec.source]}\n{spec.sql(spec.source)}"


SPECS: dict[str, Stages] = {name: make() for name, make in {**FEATURES, **SCORES}.items()}
QUERIES: dict[str, Query] = {name: _query(spec) for name, spec in SPECS.items()} | panel_queries.QUERIES | more_queries.QUERIES
ORACLE_SQL: dict[str, str] = {name: _sql(spec) for name, spec in SPECS.items()} | panel_queries.ORACLE_SQL | more_queries.ORACLE_SQL
