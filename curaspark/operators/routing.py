"""Per-class calibration and two-axis routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import vectors

FAR, LOW, WEAK, NONE = "far_from_known", "low_conf", "low_support", "no_detection"


def calibrate(golden: DataFrame, k: int = 10, conf_pct: float = 5.0, dist_pct: float = 95.0) -> DataFrame:
    """label, conf_thr, dist_thr, n_support from golden items (id, label, embedding, confidence).

    Percentiles are exact. dist_thr is over leave-one-out mean distances inside the class; a class of one has distance 0, a
    class without embeddings an infinite threshold, one without confidences a threshold of 0.
    """
    conf = golden.groupBy("label").agg(F.expr(f"percentile(confidence, {conf_pct / 100})").alias("conf_thr"), F.count("confidence").alias("n_conf"))
    own = vectors.mean_knn_distance(vectors.knn(golden, golden, k, same_label=True))
    dist = golden.where(F.col("embedding").isNotNull()).select("id", "label").join(own, "id", "left")
    dist = dist.groupBy("label").agg(F.expr(f"percentile(coalesce(knn_dist, 0D), {dist_pct / 100})").alias("dist_thr"), F.count(F.lit(1)).alias("n_dist"))
    both = conf.join(dist, "label", "full_outer")
    return both.select("label", F.coalesce("conf_thr", F.lit(0.0)).alias("conf_thr"), F.coalesce("dist_thr", F.lit(C.INF)).alias("dist_thr"), F.greatest(F.coalesce("n_conf", F.lit(0)), F.coalesce("n_dist", F.lit(0))).alias("n_support"))


def set_threshold(thresholds: DataFrame, label: str, conf_thr: float | None = None, dist_thr: float | None = None) -> DataFrame:
    """Thresholds with one class overridden."""
    hit = F.col("label") == label
    out = thresholds
    for name, value in (("conf_thr", conf_thr), ("dist_thr", dist_thr)):
        if value is not None:
            out = out.withColumn(name, F.when(hit, F.lit(float(value))).otherwise(F.col(name)))
    return out


def score_detections(dets: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """Detections (id, label, embedding, confidence, ...) with knn_dist to the golden of their own label, and low_support.

    An unknown class is infinitely far; without an embedding there is no distance and no support flag.
    """
    near = vectors.mean_knn_distance(vectors.knn(dets, golden, k, same_label=True, exclude_self=False))
    support = golden.where(F.col("embedding").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n_ref"))
    joined = dets.join(near, "id", "left").join(support, "label", "left")
    has = F.col("embedding").isNotNull()
    return joined.withColumn("knn_dist", F.when(has, F.coalesce("knn_dist", F.lit(C.INF)))).withColumn("low_support", F.when(has, F.coalesce("n_ref", F.lit(0)) < k).otherwise(F.lit(False))).drop("n_ref")


def score_images(scored: DataFrame) -> DataFrame:
    """hash, conf_max, knn_dist of scored detections; no distance at all is infinite."""
    return scored.groupBy("hash").agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("conf_max"), F.coalesce(F.max("knn_dist"), F.lit(C.INF)).alias("knn_dist"))


def route(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scored detections with decision and reasons: each axis by the thresholds of the predicted class."""
    t = thresholds.select("label", "conf_thr", "dist_thr", "n_support")
    known = F.coalesce(F.col("n_support"), F.lit(0)) > 0
    far = ~known | (F.coalesce(F.col("knn_dist"), F.lit(C.INF)) > F.col("dist_thr"))
    why = C.reasons((known & (F.col("confidence") < F.col("conf_thr")), LOW), (far, FAR), (F.coalesce(F.col("low_support"), F.lit(False)), WEAK))
    joined = scored.join(t, "label", "left").withColumn("reasons", why)
    return joined.withColumn("decision", F.when(F.size("reasons") > 0, "review").otherwise("pass")).drop("conf_thr", "dist_thr", "n_support")


def route_images(images: DataFrame, routed: DataFrame) -> DataFrame:
    """Decision of every image (hash): the sorted union of its detections' reasons; no detection means review."""
    per = routed.groupBy("hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.count(F.lit(1)).alias("n"))
    joined = images.join(per, "hash", "left")
    why = F.when(F.col("n").isNull(), F.array(F.lit(NONE))).otherwise(F.col("reasons"))
    return joined.withColumn("reasons", why).withColumn("decision", F.when(F.size("reasons") > 0, "review").otherwise("pass")).drop("n")


def flag_rate(decisions: DataFrame) -> DataFrame:
    """n, n_review, flag_rate, warning (too_many above 0.8, too_few below 0.05)."""
    one = decisions.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "review").alias("n_review"))
    rate = F.when(F.col("n") > 0, F.col("n_review") / F.col("n")).otherwise(F.lit(0.0))
    return one.withColumn("flag_rate", rate).withColumn("warning", F.when(F.col("flag_rate") > 0.8, "too_many").when(F.col("flag_rate") < 0.05, "too_few"))


def routing_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """hash, was, now, change (added, removed, changed) between two routings."""
    j = before.select("hash", F.col("decision").alias("was")).join(after.select("hash", F.col("decision").alias("now")), "hash", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return j.withColumn("change", change).where("change is not null")


def explain(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Both axes of a detection against its class thresholds: how far each is from flipping the decision."""
    t = thresholds.select("label", "conf_thr", "dist_thr", "n_support")
    j = scored.join(t, "label", "left")
    return j.select("id", "label", "confidence", "conf_thr", (F.col("confidence") - F.col("conf_thr")).alias("conf_margin"), "knn_dist", "dist_thr", (F.col("dist_thr") - F.col("knn_dist")).alias("dist_margin"), F.coalesce("n_support", F.lit(0)).alias("n_support"))


#: What each reason means to a reviewer.
SENTENCES = {LOW: "the detector is less sure than usual for this class", FAR: "the crop looks unlike the confirmed samples of its class", WEAK: "the class has too few confirmed samples to judge by", NONE: "nothing was detected in this image", "suspected_label_error": "its neighbours carry another label"}


def sentences(reasons):
    """Reason codes as one readable sentence."""
    mapping = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    text = F.array_join(F.transform(reasons, lambda r: F.coalesce(F.try_element_at(mapping, r), r)), "; ")
    return F.when(F.size(reasons) == 0, F.lit("nothing unusual")).otherwise(text)


def in_band(dets: DataFrame, lo: float = 0.05, hi: float = 0.25) -> DataFrame:
    """Detections with a vector whose confidence lies in [lo, hi): proposals the model itself doubts."""
    return dets.where(F.col("embedding").isNotNull() & (F.col("confidence") >= lo) & (F.col("confidence") < hi))
