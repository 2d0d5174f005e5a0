"""Registered queries of the model family: leakage-safe assembly, boosted trees, six classes, walk-forward, importances, a market day."""
from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from .further_queries import path_classes
from .operators import models as M
from .operators import panels as P
from .panel_queries import FACTS, facts, query, t
from .score_queries import assign_pool, position_size, scored
from .sources.scratch import kept

FEATURES = ["bias", "place", "surge"]
TRAIN_END = "1996-12-31"


def assembled(spark, sf_dir):
    """Facts with a 0/1 label, written once: models read it several times."""
    d = facts(spark, sf_dir).where("r_20 IS NOT NULL").withColumn("up", (F.col("r_20") >= 1).cast("double"))
    return kept(d.select("symbol", "trade_date", "industry", *FEATURES, "r_20", "max_gain_20", "up"), "assembled")


@query(f"{FACTS}, dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS k FROM (SELECT DISTINCT trade_date FROM facts WHERE r_20 IS NOT NULL AND trade_date <= DATE '{TRAIN_END}')), c AS (SELECT min(trade_date) AS last FROM dd WHERE k <= 21), i AS (SELECT industry, row_number() OVER (ORDER BY industry) - 1 AS id FROM (SELECT DISTINCT industry FROM facts)) SELECT symbol, trade_date, CASE WHEN trade_date > DATE '{TRAIN_END}' THEN 'test' ELSE 'train' END AS side, r_20 >= 1 AS up, CAST(id AS INTEGER) AS industry_id FROM facts JOIN i USING (industry), c WHERE r_20 IS NOT NULL AND (trade_date <= last OR trade_date > DATE '{TRAIN_END}')", "panel")
def ml01_time_split(spark, sf_dir):
    """Train rows whose label has ended by the split, test rows after it, the label by a threshold and an id of the industry."""
    train, test = M.split(assembled(spark, sf_dir), "r_20", TRAIN_END)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    ids = both.select("industry").distinct().withColumn("industry_id", F.row_number().over(Window.orderBy("industry")) - 1)  # one row an industry
    return both.join(ids, "industry").select("symbol", "trade_date", "side", (F.col("up") == 1).alias("up"), "industry_id")


@query("")
def ml02_boosted_trees(spark, sf_dir):
    """Regression and weighted classification on the train side, both scored on the test side."""
    train, test = M.split(assembled(spark, sf_dir), "r_20", TRAIN_END)
    train = kept(train, "train")
    regression, classifier = M.fit_gbt(train, FEATURES, "r_20"), M.fit_classifier(train, FEATURES, "up", "industry")
    d = regression.transform(test).select("symbol", "trade_date", "industry", *FEATURES, "r_20", "up", "pred")
    d = classifier.transform(d).withColumn("probability_up", vector_to_array("probability")[1])
    return d.select("symbol", "trade_date", "r_20", "up", "pred", "probability_up")


@query("")
def ml03_path_classifier(spark, sf_dir):
    """The six path classes by a forest, and its class for every test row."""
    labels = path_classes(t(spark, sf_dir, "bars"), 0.2).select("symbol", "trade_date", "label")
    train, test = M.split(kept(assembled(spark, sf_dir).join(labels, ["symbol", "trade_date"]), "labelled"), "r_20", TRAIN_END)
    model = M.fit_classes(train, FEATURES, "label")
    names = F.array(*map(F.lit, model.stages[0].labels))
    return model.transform(test).select("symbol", "trade_date", "label", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


@query("")
def ml04_walk_forward(spark, sf_dir):
    """Five windows, each trained on all before it: rows, AUC and rank correlation, with two sets of features."""
    d, out = assembled(spark, sf_dir), []
    for year in (1997, 1998, 1999, 2000, 2001):
        for name, features in (("all", FEATURES), ("price", FEATURES[:2])):
            train, test = M.split(d, "r_20", f"{year - 1}-12-31")
            got = M.fit_gbt(train, features, "r_20", trees=4, depth=3).transform(test.where(F.year("trade_date") == year))
            got = got.withColumns({"window": F.lit(year), "features": F.lit(name), "y": (F.col("r_20") > 0).cast("int")})
            area = P.auc(got, "pred", "y", ["window", "features"])
            ic = got.groupBy("window", "features").agg(P.correlation("pred", "r_20").alias("ic"))
            out.append(area.join(ic, ["window", "features"]))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("")
def ml06_importances(spark, sf_dir):
    train, _ = M.split(assembled(spark, sf_dir), "r_20", TRAIN_END)
    return M.importances(M.fit_gbt(train, FEATURES, "r_20"), FEATURES, spark)


@query("")
def ml07_market_day(spark, sf_dir):
    """One date: predictions with anchors, quadrant, rules, at most two a sector, pools and sizes."""
    d = kept(scored(spark, sf_dir), "scored")
    train, _ = M.split(d.where("r_20 IS NOT NULL"), "r_20", TRAIN_END)
    model = M.fit_gbt(kept(train.select(*FEATURES, "r_20"), "train"), FEATURES, "r_20")
    day = d.where("trade_date = DATE '1997-03-03'")
    got = M.anchored(model.transform(day), model.transform(train.select(*FEATURES)))
    c = F.col
    quadrant = F.when((c("score") >= 60) & (c("place_s") < 40), "mixed").when((c("score") < 40) & (c("place_s") < 40), "short").otherwise("other")
    made = {"buy": c("score"), "sell": 100 - c("place_s"), "sell_prob": 1 - c("place_s") / 100, "recommended": (c("score") >= 80) & (c("place_s") >= 80), "is_zombie": (c("zombie_days") > 0.6) & (F.abs("slope60") < 0.002), "quadrant": quadrant}
    got = got.withColumns(made).withColumn("pool", assign_pool()).withColumn("size", position_size(0.8))
    k = F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("score"), "symbol"))
    return got.withColumn("k", k).where("k <= 2").select("symbol", "industry", "score", "quadrant", "pool", "size")
