"""Clusters of a two-dimensional map and how pure their labels are."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clusters(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Points (id, label, embedding) with their k-means cluster."""
    v = points.where(F.col("embedding").isNotNull()).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).drop("features")


def purity(clustered: DataFrame) -> DataFrame:
    """cluster, n, label, purity of each cluster's most frequent label, purest first."""
    n = clustered.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("cluster")
    top = n.withColumn("n", F.sum("k").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("k"), "label"))).where("r = 1")
    return top.select("cluster", "n", "label", (F.col("k") / F.col("n")).alias("purity")).orderBy(F.desc("purity"), F.desc("n"), "cluster")
