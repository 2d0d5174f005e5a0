"""Models over panels: leakage-safe split, gradient-boosted trees, walk-forward evaluation, scoring with anchors."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panels import percentiles


def split(d: DataFrame, label: str, train_end: str, gap_rows: int = 20, at: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """Rows up to `train_end` whose label has ended by then, and rows after it."""
    dates = d.select(at).distinct()
    last = dates.where(F.col(at) <= train_end).orderBy(F.desc(at)).limit(gap_rows + 1).agg(F.min(at).alias("last"))  # one row
    some = d.where(F.col(label).isNotNull())
    return some.crossJoin(F.broadcast(last)).where(F.col(at) <= F.col("last")).drop("last"), some.where(F.col(at) > train_end)


def fit_gbt(train: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 4) -> PipelineModel:
    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__x"), GBTRegressor(featuresCol="__x", labelCol=label, predictionCol="pred", maxIter=trees, maxDepth=depth, seed=7)]).fit(train)


def _inputs(features: list[str], industry: str | None) -> list:
    filled = [f"{f}__f" for f in features]
    stages: list = [Imputer(inputCols=features, outputCols=filled, strategy="median")]
    if industry:
        stages.append(StringIndexer(inputCol=industry, outputCol="__industry", handleInvalid="keep", stringOrderType="alphabetAsc"))
    return [*stages, VectorAssembler(inputCols=[*filled, *(["__industry"] if industry else [])], outputCol="__x")]


def weighted(train: DataFrame, label: str, into: str = "weight") -> DataFrame:
    """Rows of the rarer class weigh as much more as they are fewer; one row of counts is joined."""
    n = train.agg(F.sum(F.col(label)).alias("__p"), F.count(F.lit(1)).alias("__n"))
    w = F.when(F.col(label) == 1, (F.col("__n") - F.col("__p")) / F.greatest(F.col("__p"), F.lit(1))).otherwise(1.0)
    return train.join(F.broadcast(n)).withColumn(into, w).drop("__p", "__n")


def fit_classifier(train: DataFrame, features: list[str], label: str, industry: str | None = None, trees: int = 8, depth: int = 3) -> PipelineModel:
    """Boosted trees for a 0/1 label with class weights; missing features are the median."""
    model = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=7, maxBins=64)
    return Pipeline(stages=[*_inputs(features, industry), model]).fit(weighted(train, label))


def fit_classes(train: DataFrame, features: list[str], label: str, trees: int = 12, depth: int = 5) -> PipelineModel:
    """A forest over the classes named in a text column."""
    index = StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, *_inputs(features, None), RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=7)]).fit(train)


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted pipeline: one row a feature."""
    got = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, got)), "feature string, importance double")


def anchored(scored: DataFrame, reference: DataFrame, pred: str = "pred") -> DataFrame:
    """`score` of 0 to 100 by the 5th, 50th and 95th percentile of the reference predictions."""
    a = percentiles(reference, pred, {"__lo": 0.05, "__mid": 0.5, "__hi": 0.95})
    x, (lo, mid, hi) = F.col(pred), map(F.col, a.columns)
    below, above = 50 * (x - lo) / F.nullif(mid - lo, F.lit(0.0)), 50 + 50 * (x - mid) / F.nullif(hi - mid, F.lit(0.0))
    s = F.when(x <= lo, 0.0).when(x >= hi, 100.0).when(x < mid, below).otherwise(above)
    return scored.crossJoin(F.broadcast(a)).withColumn("score", F.coalesce(s, F.lit(50.0))).drop(*a.columns)
