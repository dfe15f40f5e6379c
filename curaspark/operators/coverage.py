"""Coverage, novelty and the rankings built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import vectors


def coverage_gaps(items: DataFrame, target: float | None = None) -> DataFrame:
    """label, n, under_represented, need: counts against the median class size, or an explicit target."""
    counts = items.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    mid = counts.agg(F.expr("percentile(n, 0.5)").alias("median"))
    j = counts.join(F.broadcast(mid))
    goal = F.col("median") if target is None else F.lit(float(target))
    under = F.col("n") < (0.5 * F.col("median") if target is None else goal)
    need = F.when(under, F.greatest(F.lit(0), F.ceil(goal) - F.col("n"))).otherwise(F.lit(0))
    return j.select("label", "n", under.alias("under_represented"), need.cast("long").alias("need"))


def sparse_items(items: DataFrame, k: int = 5, quantile: float = 0.9) -> DataFrame:
    """Items in the sparsest part of their class: id, label, density at or above the class quantile."""
    own = vectors.mean_knn_distance(vectors.knn(items, items, k, same_label=True)).join(items.select("id", "label"), "id")
    cut = own.groupBy("label").agg(F.expr(f"percentile(knn_dist, {quantile})").alias("thr"))
    return own.join(cut, "label").where("round(knn_dist, 9) >= round(thr, 9)").select("id", "label", F.col("knn_dist").alias("density"))


def coverage_delta(new: DataFrame, existing: DataFrame, radius: float = 0.2) -> DataFrame:
    """One row: n, novel, novel_fraction of new items farther than the radius from all existing ones."""
    near = new.select("id").join(vectors.nearest(new, existing).select("id", "distance"), "id", "left")
    novel = F.coalesce(F.col("distance"), F.lit(C.INF)) > radius
    one = near.agg(F.count(F.lit(1)).alias("n"), F.count_if(novel).alias("novel"))
    return one.withColumn("novel_fraction", F.when(F.col("n") > 0, F.col("novel") / F.col("n")).otherwise(F.lit(0.0)))


def review_queue(candidates: DataFrame, reference: DataFrame, k: int = 10, dist_norm: float = 0.5, issues: DataFrame | None = None, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), limit: int | None = None) -> DataFrame:
    """id, risk, reasons, conf, knn_dist, riskiest first: uncertainty, novelty and suspected label errors."""
    near = vectors.mean_knn_distance(vectors.knn(candidates, reference, k, exclude_self=False))
    j = candidates.select("id", "confidence").join(near, "id", "left")
    wrong = F.lit(False)
    if issues is not None:
        j = j.join(issues.select("id", F.lit(True).alias("issue")), "id", "left")
        wrong = F.coalesce(F.col("issue"), F.lit(False))
    unc = 1 - F.col("confidence")
    nov = F.least(F.lit(1.0), F.coalesce(F.col("knn_dist"), F.lit(C.INF)) / dist_norm)
    risk = weights[0] * unc + weights[1] * nov + weights[2] * wrong.cast("double")
    out = j.select("id", risk.alias("risk"), C.reasons((unc >= 0.5, "low_conf"), (nov >= 0.5, "far_from_known"), (wrong, "suspected_label_error")).alias("reasons"), F.col("confidence").alias("conf"), C.finite(F.coalesce(F.col("knn_dist"), F.lit(C.INF))).alias("knn_dist"))
    out = out.orderBy(F.round("risk", 9).desc(), "id")
    return out if limit is None else out.limit(limit)


def harmful(items: DataFrame, issues: DataFrame, duplicates: DataFrame, k: int = 5, weights: tuple[float, float, float] = (0.5, 0.25, 0.25), top: int = 50) -> DataFrame:
    """id, harm, reasons of the ``top`` most harmful items: label errors, duplicates, outliers."""
    out = vectors.mean_knn_distance(vectors.knn(items, items, k))
    j = items.select("id").join(out, "id", "left").join(issues.select("id", F.lit(1).alias("lbl")), "id", "left").join(duplicates.select("id", F.lit(1).alias("dup")), "id", "left")
    lone = F.coalesce(F.col("knn_dist"), F.lit(1.0))
    lbl, dup = F.coalesce("lbl", F.lit(0)), F.coalesce("dup", F.lit(0))
    harm = weights[0] * lbl + weights[1] * dup + weights[2] * lone
    why = C.reasons((lbl == 1, "suspected_label_error"), (dup == 1, "duplicate"), (lone > 0.5, "outlier"))
    return j.select("id", harm.alias("harm"), why.alias("reasons")).orderBy(F.round("harm", 9).desc(), "id").limit(top)


def active_learning(candidates: DataFrame, existing: DataFrame, budget: int, alpha: float = 0.5, shortlist: int = 20_000) -> DataFrame:
    """rank, id, uncertainty, novelty, score of ``budget`` candidates picked greedily for uncertainty and diversity.

    A pick lowers the score of candidates like it by (1 - alpha) / 2 x max(0, cosine). Scores only fall, so the budget best
    by first score bound what can be picked; Spark scores all candidates and the greedy part runs over the ``shortlist`` best
    of them, exact whenever the last score picked is not below the best score left out, which is checked.
    """
    near = candidates.select("id", "confidence", "embedding").where(F.col("embedding").isNotNull()).join(vectors.nearest(candidates, existing).select("id", "distance"), "id", "left")
    near = near.withColumn("raw", F.coalesce("distance", F.lit(1.0)))
    span = near.agg(F.min("raw").alias("lo"), (F.max("raw") - F.min("raw")).alias("span"))
    scored = near.join(F.broadcast(span)).select("id", "embedding", (1 - F.col("confidence")).alias("uncertainty"), ((F.col("raw") - F.col("lo")) / (F.col("span") + 1e-12)).alias("novelty"))
    scored = scored.withColumn("score", alpha * F.col("uncertainty") + (1 - alpha) * F.col("novelty"))
    spark, kind = candidates.sparkSession, candidates.schema["id"].dataType.simpleString()
    size = max(shortlist, budget)
    while True:
        rows = scored.orderBy(F.desc("score"), "id").limit(size + 1).collect()
        left = rows[size]["score"] if len(rows) > size else -C.INF
        rows = rows[:size]
        picked, score = [], np.array([r.score for r in rows])
        m = np.array([r.embedding for r in rows], float).reshape(len(rows), -1)
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
        alive = np.ones(len(rows), bool)
        sure = True
        while alive.any() and len(picked) < budget:
            i = int(np.flatnonzero(alive)[np.argmax(score[alive])])
            sure &= bool(score[i] >= left)
            r = rows[i]
            picked.append((len(picked) + 1, r.id, float(r.uncertainty), float(r.novelty), float(score[i])))
            alive[i] = False
            score = score - 0.5 * (1 - alpha) * np.maximum(0.0, m @ m[i])
        if sure or len(rows) < size:
            break
        size *= 4
    return spark.createDataFrame(picked, f"rank int, id {kind}, uncertainty double, novelty double, score double")


def overturns(dets: DataFrame, top: int = 50, eps: float = 1e-9) -> DataFrame:
    """Confident detections (id, label, confidence, knn_dist, conf_thr, dist_thr) that their embedding contradicts."""
    thr = F.col("dist_thr")
    ok = (F.col("confidence") >= F.col("conf_thr")) & (thr < C.INF) & (thr > 0) & (F.col("knn_dist") > thr)
    wrong = F.col("confidence") * (F.least(F.col("knn_dist"), F.lit(2.0)) - thr) / (thr + eps)
    rows = dets.where(ok).select("id", F.col("label").alias("pred_class"), F.round("confidence", 4).alias("conf"), F.round(C.finite(F.col("knn_dist")), 4).alias("knn_dist"), F.round(thr, 4).alias("dist_thr"), F.round(wrong, 4).alias("wrongness"))
    return rows.orderBy(F.desc("wrongness"), "id").limit(top)


def error_regions(errors: DataFrame, dets: DataFrame, fp_iou: float = 0.5, fn_iou: float = 0.1, for_class: str | None = None) -> DataFrame:
    """id, label, embedding of the regions that errors point at.

    An error box (hash, kind fp or fn, error_id, label, box) is found among the stored detections (hash, pos, embedding, box)
    of its image: the best overlap that reaches the threshold of its kind, the last one in case of a tie. With all classes,
    an image none of whose errors is found counts by the mean of its vectors; with one class it doesn't.
    """
    e = errors if for_class is None else errors.where(F.col("label") == for_class)
    side = [F.col(c).alias(f"d_{c}") for c in ("cx", "cy", "w", "h")]
    stored = dets.where(F.col("embedding").isNotNull())
    v = C.iou(C.box(), C.box("d_"))
    least = F.when(F.col("kind") == "fp", F.lit(fp_iou)).otherwise(F.lit(fn_iou))
    near = e.join(stored.select("hash", "pos", "embedding", *side), "hash").withColumn("v", v).where(F.col("v") >= least)
    best = near.groupBy("hash", "kind", "error_id").agg(F.max_by("embedding", F.struct("v", "pos")).alias("embedding"))
    out = best.select(F.concat_ws(":", "hash", "kind", "error_id").alias("id"), F.lit(None).cast("string").alias("label"), "embedding")
    if for_class is not None:
        return out
    lost = e.select("hash").distinct().join(best.select("hash").distinct(), "hash", "left_anti")
    flat = stored.join(lost, "hash").select("hash", F.posexplode("embedding").alias("k", "x"))
    mean = flat.groupBy("hash", "k").agg(F.avg("x").alias("x")).groupBy("hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("embedding"))
    return out.unionByName(mean.select(F.concat_ws(":", "hash", F.lit("image")).alias("id"), F.lit(None).cast("string").alias("label"), "embedding"))


def error_mine_boxes(candidates: DataFrame, errors: DataFrame, dets: DataFrame, top: int = 20, for_class: str | None = None, **how) -> DataFrame:
    """id, closeness, region: candidates (id, embedding) by their cosine to the nearest error region."""
    c = candidates.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("label"), "embedding")
    near = vectors.knn(c, error_regions(errors, dets, for_class=for_class, **how), 1, exclude_self=False)
    return near.select("id", F.round("sim", 4).alias("closeness"), F.col("nid").alias("region")).orderBy(F.desc("closeness"), "id").limit(top)


def error_mine(candidates: DataFrame, errors: DataFrame, top: int = 50) -> DataFrame:
    """Candidates most like any error region: id, error_id, similarity."""
    near = vectors.knn(candidates, errors, 1, exclude_self=True)
    return near.select("id", F.col("nid").alias("error_id"), F.col("sim").alias("similarity")).orderBy(F.round("similarity", 9).desc(), "id").limit(top)
