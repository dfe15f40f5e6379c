"""Label auditing: k-NN majorities, confident learning, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors


def majority(near: DataFrame) -> DataFrame:
    """id, label, n, majority, majority_n, own_n of each query; ties go to the smaller label."""
    votes = near.groupBy("id", "label", "nlabel").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("id").orderBy(F.col("votes").desc(), "nlabel")
    every = Window.partitionBy("id")
    ranked = votes.withColumn("r", F.row_number().over(best)).withColumn("n", F.sum("votes").over(every)).withColumn("own_n", F.coalesce(F.sum(F.when(F.col("nlabel") == F.col("label"), F.col("votes"))).over(every), F.lit(0)))
    return ranked.where("r = 1").select("id", "label", "n", F.col("nlabel").alias("majority"), F.col("votes").alias("majority_n"), "own_n")


def suspected_errors(items: DataFrame, k: int = 10) -> DataFrame:
    """Items whose neighbours mostly carry another label: id, given_label, suggested_label, disagreement."""
    m = majority(vectors.knn(items, items, k))
    return m.where("majority <> label").select("id", F.col("label").alias("given_label"), F.col("majority").alias("suggested_label"), ((F.col("majority_n") - F.col("own_n")) / F.col("n")).alias("disagreement"))


def distribution(items: DataFrame) -> DataFrame:
    return items.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def with_predictions(items: DataFrame, k: int = 10) -> DataFrame:
    """id, given, pred, conf: the neighbours' majority as prediction, with the item's own confidence."""
    m = majority(vectors.knn(items, items, k)).select("id", F.col("majority").alias("pred"))
    return items.select("id", F.col("label").alias("given"), F.col("confidence").alias("conf")).join(m, "id")


def _confident(rows: DataFrame) -> DataFrame:
    means = rows.groupBy("pred").agg(F.avg("conf").alias("thr"))
    return rows.join(means, "pred").where("conf >= thr - 1e-9")


def confident_joint(rows: DataFrame) -> DataFrame:
    """given, pred, n: rows at or above the mean confidence of their predicted class."""
    return _confident(rows).groupBy("given", "pred").agg(F.count(F.lit(1)).alias("n"))


def noise_rates(joint: DataFrame) -> DataFrame:
    """given, pred, rate: off-diagonal share of each given label."""
    w = Window.partitionBy("given")
    return joint.withColumn("rate", F.round(F.col("n") / F.sum("n").over(w), 4)).where("given <> pred").select("given", "pred", "rate")


def confident_issues(rows: DataFrame) -> DataFrame:
    """Rows given one label and confidently predicted another, most confident first."""
    return _confident(rows).where("given <> pred").select("id", F.col("given").alias("given_label"), F.col("pred").alias("pred_label"), F.col("conf").alias("confidence")).orderBy(F.desc("confidence"), "id")


def outlier_rank(items: DataFrame, k: int = 8) -> DataFrame:
    """id, outlier: mean distance to the k nearest, most isolated first."""
    return vectors.mean_knn_distance(vectors.knn(items, items, k)).select("id", F.col("knn_dist").alias("outlier")).orderBy(F.desc("outlier"), "id")


# relabelling ----------------------------------------------------------------


def align_class_maps(a: DataFrame, b: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Two maps (cid, name) in one namespace: name, new_id, id_a, id_b, side (common, only_a, only_b)."""

    def canon(m: DataFrame) -> DataFrame:
        if overrides is None:
            return m.select("cid", "name")
        o = overrides.select(F.col("old").alias("name"), F.col("new").alias("canon"))
        return m.join(o, "name", "left").select("cid", F.coalesce("canon", "name").alias("name"))

    x, y = canon(a).select("name", F.col("cid").alias("id_a")), canon(b).select("name", F.col("cid").alias("id_b"))
    both = x.join(y, "name", "full_outer")
    side = F.when(F.col("id_a").isNull(), "only_b").when(F.col("id_b").isNull(), "only_a").otherwise("common")
    return both.select("name", (F.dense_rank().over(Window.orderBy("name")) - 1).alias("new_id"), "id_a", "id_b", side.alias("side"))


def relabel(items: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with labels renamed by (old, new), and the change log (id, old, new); several names may merge into one."""
    joined = items.join(mapping.select(F.col("old").alias("label"), "new"), "label", "left").withColumn("to", F.coalesce("new", "label"))
    changes = joined.where("to <> label").select("id", F.col("label").alias("old"), F.col("to").alias("new"))
    return joined.drop("label", "new").withColumnRenamed("to", "label"), changes


def rollback(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the last logged old label of each id, log lines ordered by ``line``."""
    last = log.groupBy("id").agg(F.max_by("old", "line").alias("was"))
    return items.join(last, "id", "left").withColumn("label", F.coalesce("was", "label")).drop("was")


def migration_diff(changes: DataFrame) -> DataFrame:
    return changes.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def merged_distribution(a: DataFrame, b: DataFrame, mapping: DataFrame) -> DataFrame:
    """label, n of two datasets under a common naming, before anything is merged."""
    m = mapping.select(F.col("old").alias("label"), "new")
    both = distribution(a).unionByName(distribution(b)).join(m, "label", "left")
    return both.groupBy(F.coalesce("new", "label").alias("label")).agg(F.sum("n").alias("n"))


def merge_datasets(a: DataFrame, b: DataFrame, overrides: DataFrame) -> DataFrame:
    """name, new_id, n, side, needs_decision of two datasets (id, label) under common names, before anything is merged.

    ``overrides`` (old, new) rename classes first; a class that only one side has needs a decision. Names are ranked in one
    task, as there is one row a class.
    """
    n = merged_distribution(a, b, overrides)
    ids = lambda x: x.select("label").distinct().select(F.dense_rank().over(Window.orderBy("label")).alias("cid"), F.col("label").alias("name"))
    m = align_class_maps(ids(a), ids(b), overrides).groupBy("name", "new_id").agg(F.min("id_a").alias("id_a"), F.min("id_b").alias("id_b"))
    side = F.when(F.col("id_a").isNull(), "only_b").when(F.col("id_b").isNull(), "only_a").otherwise("common")
    return m.join(n.withColumnRenamed("label", "name"), "name").select("name", "new_id", "n", side.alias("side"), (side != "common").alias("needs_decision"))


def class_pairs(items: DataFrame) -> DataFrame:
    """All unordered pairs of classes."""
    c = items.select("label").distinct()
    return c.select(F.col("label").alias("a")).join(c.select(F.col("label").alias("b")), F.col("a") < F.col("b"))
