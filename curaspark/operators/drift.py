"""Drift: anchors, periods, kinds of shift, geometry, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import vectors


def centroid_shift(anchor: DataFrame, new: DataFrame, normalise_first: bool = False) -> DataFrame:
    """label, shift: cosine distance between class centroids of both sides."""
    a = vectors.centroids(anchor, ["label"], normalise_first).withColumnRenamed("centroid", "ca")
    b = vectors.centroids(new, ["label"], normalise_first).withColumnRenamed("centroid", "cb")
    return a.join(b, "label").select("label", (F.lit(1.0) - C.dot(F.col("ca"), F.col("cb"))).alias("shift"))


def label_consistency(queries: DataFrame, refs: DataFrame, k: int = 10) -> DataFrame:
    """One row, consistency: share of queries whose k-NN majority is their own label.

    A first neighbour with cosine above 0.99999 is taken for the query itself and skipped.
    """
    near = vectors.knn(queries, refs, k + 1, exclude_self=False)
    w = Window.partitionBy("id")
    near = near.withColumn("skip", (F.max(F.when(F.col("rank") == 1, F.col("sim"))).over(w) > 0.99999).cast("int"))
    near = near.where((F.col("rank") > F.col("skip")) & (F.col("rank") <= k + F.col("skip")))
    votes = near.groupBy("id", "label", "nlabel").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("votes"), "nlabel"))).where("r = 1")
    return best.agg(F.coalesce(F.avg((F.col("nlabel") == F.col("label")).cast("double")), F.lit(1.0)).alias("consistency"))


def guard(anchor: DataFrame, golden: DataFrame, new: DataFrame, shift_thr: float = 0.15, drop_thr: float = 0.05, k: int = 10) -> DataFrame:
    """One row: max_shift, baseline, consistency, drop, triggered, reasons of a new batch against the frozen anchor."""
    shift = centroid_shift(anchor, new).agg(F.coalesce(F.max("shift"), F.lit(0.0)).alias("max_shift"))
    base = label_consistency(anchor, golden, k).withColumnRenamed("consistency", "baseline")
    cons = label_consistency(new, anchor, k)
    one = shift.join(F.broadcast(base)).join(F.broadcast(cons)).withColumn("drop", F.col("baseline") - F.col("consistency"))
    one = one.withColumn("reasons", C.reasons((F.col("max_shift") > shift_thr, "centroid_shift"), (F.col("drop") > drop_thr, "consistency_drop")))
    return one.withColumn("triggered", F.size("reasons") > 0)


def cross_period(a: DataFrame, b: DataFrame, threshold: float = 0.15) -> DataFrame:
    """label, shift, alert between two periods (centroids of normalised vectors)."""
    return centroid_shift(a, b, True).withColumn("alert", F.col("shift") > threshold)


def representatives(a: DataFrame, b: DataFrame, top: int = 3) -> DataFrame:
    """label, id, distance, rank: rows of b farthest from the class centroid of a."""
    ca = vectors.centroids(a, ["label"], True)
    d = b.where(F.col("embedding").isNotNull()).join(ca, "label").select("label", "id", (F.lit(1.0) - C.dot(C.l2(F.col("embedding")), F.col("centroid"))).alias("distance"))
    w = Window.partitionBy("label").orderBy(F.round("distance", 9).desc(), "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _shares(df: DataFrame, name: str) -> DataFrame:
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("label", (F.col("n") / F.col("all")).alias(name))


def drift_type(a: DataFrame, b: DataFrame, cov_thr: float = 0.15, pred_thr: float = 0.05) -> DataFrame:
    """One row: covariate_shift, prediction_shift (Jensen-Shannon, nats), verdict both/covariate/concept/none."""
    one = lambda x: vectors.centroids(x.withColumn("all", F.lit(1)), ["all"])
    cov = one(a).withColumnRenamed("centroid", "ca").join(one(b).withColumnRenamed("centroid", "cb"), "all", "full_outer")
    cov = cov.agg(F.coalesce(F.max(F.lit(1.0) - C.dot(F.col("ca"), F.col("cb"))), F.lit(0.0)).alias("cov"))
    mix = _shares(a, "p").join(_shares(b, "q"), "label", "full_outer").select((F.coalesce("p", F.lit(0.0)) + 1e-12).alias("p"), (F.coalesce("q", F.lit(0.0)) + 1e-12).alias("q"))
    total = mix.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    norm = mix.join(F.broadcast(total)).select((F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    js = norm.agg(F.coalesce(F.sum(0.5 * F.col("p") * F.log(F.col("p") / F.col("m")) + 0.5 * F.col("q") * F.log(F.col("q") / F.col("m"))), F.lit(0.0)).alias("js"))
    j = cov.join(F.broadcast(js))
    is_cov, is_pred = F.col("cov") > cov_thr, F.col("js") > pred_thr
    return j.select(F.round("cov", 4).alias("covariate_shift"), F.round("js", 4).alias("prediction_shift"), F.when(is_cov & is_pred, "both").when(is_cov, "covariate").when(is_pred, "concept").otherwise("none").alias("verdict"))


def geometry_stats(boxes: DataFrame, by: list[str]) -> DataFrame:
    """by..., n and mean, p05, p95 of width, height and aspect."""
    b = boxes.withColumn("aspect", F.col("w") / F.greatest(F.col("h"), F.lit(1e-9)))
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in ("w", "h", "aspect"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.expr(f"percentile({c}, 0.05)").alias(f"{c}_p05"), F.expr(f"percentile({c}, 0.95)").alias(f"{c}_p95")]
    return b.groupBy(*by).agg(*aggs)


def geometry_drift(a: DataFrame, b: DataFrame, threshold: float = 0.2) -> DataFrame:
    """One row: absolute shifts of mean w, h, aspect and of the 95th percentiles of w and h, and whether any passes the threshold."""
    x, y = (geometry_stats(s, []) for s in (a, b))
    names = ["w_mean", "h_mean", "aspect_mean", "w_p95", "h_p95"]
    j = x.select(*[F.col(c).alias(f"a_{c}") for c in ("n", *names)]).join(F.broadcast(y.select(*[F.col(c).alias(f"b_{c}") for c in ("n", *names)])))
    shifts = {c: F.when((F.col("a_n") > 0) & (F.col("b_n") > 0), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))) for c in names}
    out = j.select(*[s.alias(c) for c, s in shifts.items()])
    return out.withColumn("alert", F.coalesce(F.greatest(*names) > threshold, F.lit(False)))


def parity(rows: DataFrame, threshold: float = 0.1, min_samples: int = 3) -> DataFrame:
    """grp, value, n, rel_to_median, low_confidence, worse of per-group means (grp, value) against the fleet median."""
    g = rows.groupBy("grp").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    mid = g.agg(F.coalesce(F.expr(f"percentile(value, 0.5) filter (where n >= {min_samples})"), F.expr("percentile(value, 0.5)")).alias("median"))
    j = g.join(F.broadcast(mid))
    rel = F.when(F.col("median") != 0, (F.col("value") - F.col("median")) / F.col("median")).otherwise(F.lit(0.0))
    low = F.col("n") < min_samples
    return j.select("grp", "value", "n", F.round(rel, 4).alias("rel_to_median"), low.alias("low_confidence"), ((rel < -threshold) & ~low).alias("worse"))


def quality_trend(items: DataFrame, threshold: float = 0.15) -> DataFrame:
    """label, batch, mean_conf, n, drop, alert on the full class x batch grid; a gap breaks the comparison."""
    cells = items.where("batch <> ''").groupBy("label", "batch").agg(F.avg("confidence").alias("mean_conf"), F.count(F.lit(1)).alias("n"))
    names, batches = items.select("label").distinct(), items.where("batch <> ''").select("batch").distinct()
    grid = names.join(F.broadcast(batches)).join(cells, ["label", "batch"], "left")
    before = F.lag("mean_conf").over(Window.partitionBy("label").orderBy("batch"))
    out = grid.withColumn("drop", before - F.col("mean_conf"))
    return out.select("label", "batch", "mean_conf", F.coalesce("n", F.lit(0)).alias("n"), "drop", F.coalesce(F.col("drop") > threshold, F.lit(False)).alias("alert"))
