"""Classifiers and clusters of segments by Spark's own learners: balanced classes, cells held out,
outliers by silhouette, models kept with what they were taught."""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaspan.sources.shared import kept


def complete(features: Sequence[str]) -> Column:
    """Whether a row has a number in every feature."""
    return functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``, so that every class counts as much as any other. There are few classes."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    whole = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(n), label).join(F.broadcast(whole), how="cross").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")  # one row of totals


def forest(rows: DataFrame, features: Sequence[str], label: str, trees: int = 300, depth: int = 10, seed: int = 1) -> PipelineModel:
    """A forest over balanced classes, from the rows that have all features."""
    ready = balanced(rows.where(complete(features) & F.col(label).isNotNull()), label)
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(ready)
    stages = [
        indexer, VectorAssembler(inputCols=list(features), outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="_label", predictionCol="_p", probabilityCol="_probability", rawPredictionCol="_raw", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
        IndexToString(inputCol="_p", outputCol="predicted", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(ready)


def predicted(rows: DataFrame, model: PipelineModel, features: Sequence[str], missing: str = "-1") -> DataFrame:
    """Adds ``predicted`` and ``confidence``; rows that lack a feature are ``missing``."""
    inner = PipelineModel([s for s in model.stages if not type(s).__name__.startswith("StringIndexer")])  # labels aren't needed
    found = inner.transform(rows.where(complete(features))).withColumn("confidence", F.array_max(vector_to_array("_probability"))).drop("_x", "_p", "_probability", "_raw")
    return found.unionByName(rows.where(~complete(features)).withColumns({"predicted": F.lit(missing), "confidence": F.lit(None).cast("double")}))


def held_out(rows: DataFrame, features: Sequence[str], label: str, group: str, trees: int = 300, folds: int = 5, depth: int = 10) -> DataFrame:
    """Each row with what a forest says that has seen no row of its group: groups are dealt into
    ``folds`` in their order, and each fold is predicted from the others. As many folds as groups
    leave one out; folds beyond the groups are none. Groups are few (the cells of a fleet)."""
    place = F.row_number().over(Window.orderBy(group)) - 1
    of = rows.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_fold", place % folds)
    dealt = kept(rows.join(of, group), "dealt")
    found = [k for (k,) in of.select("_fold").distinct().orderBy("_fold").collect()]
    parts = [predicted(dealt.where(F.col("_fold") == k), forest(dealt.where(F.col("_fold") != k), features, label, trees, depth), features) for k in found]
    return functools.reduce(DataFrame.unionByName, parts).drop("_fold")


def centred(rows: DataFrame, features: Sequence[str], k: int = 10, seed: int = 1) -> DataFrame:
    """Adds ``cluster`` of k centres over scaled features, ``silhouette`` by the distances to the own
    and the nearest other centre, and whether that makes the row an outlier (below zero: it is
    nearer to another). Rows that lack a feature are left out."""
    ready = rows.where(complete(features))
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z"), KMeans(featuresCol="_z", predictionCol="cluster", k=k, seed=seed)]
    model = Pipeline(stages=stages).fit(ready)
    centres = [c.tolist() for c in model.stages[-1].clusterCenters()]  # k rows
    x = vector_to_array("_z")
    distances = F.array(*[F.sqrt(F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)) for c in centres])
    found = model.transform(ready).withColumn("_d", distances)
    own = F.get("_d", F.col("cluster"))
    other = F.array_min(F.transform("_d", lambda d, i: F.when(i != F.col("cluster"), d)))
    silhouette = F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0))
    return found.withColumn("silhouette", silhouette).withColumn("outlier", F.col("silhouette") < 0).drop("_x", "_z", "_d")


def stored(model: PipelineModel, path: str, facts: dict) -> None:
    """A model with what it was taught: features, labels and whatever else is told."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").write.mode("overwrite").text(f"{path}/facts")


def loaded(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/facts").first()[0])
