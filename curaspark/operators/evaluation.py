"""Detection evaluation: greedy matching, average precision, typed errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def _iou(a, b):
    """Overlap of two structs with cx, cy, w, h."""
    return C.iou(tuple(a[c] for c in ("cx", "cy", "w", "h")), tuple(b[c] for c in ("cx", "cy", "w", "h")))


def match(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float] = (0.5,)) -> DataFrame:
    """image_id, label, thr, pred_id, conf, gt_id: greedy class-specific matching, gt_id null for a false positive.

    Inside one image and class predictions take, most confident first, the free truth they overlap most, the last one in case
    of a tie, if the overlap reaches the threshold. The state - which truths are used - runs through a fold over the group's
    predictions; groups are images x classes x thresholds, so the fold is short and everything else is parallel.
    """
    box = F.struct("cx", "cy", "w", "h", F.col("gt_id").alias("id"))
    g = gt.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct(F.col("gt_id").alias("o"), box.alias("b")))).alias("gs"))
    pb = F.struct((-F.col("conf")).alias("neg"), F.col("pred_id").alias("o"), F.struct("cx", "cy", "w", "h", "conf", F.col("pred_id").alias("id")).alias("b"))
    p = pred.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(pb)).alias("ps"))
    j = p.join(g, ["image_id", "label"], "left").withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    key = gt.schema["gt_id"].dataType.simpleString()
    none = F.lit(None).cast(key)
    start = F.struct(F.array().cast(f"array<{key}>").alias("used"), F.array().cast(f"array<{key}>").alias("got"))

    def take(acc, x):
        free = F.filter(F.coalesce("gs", F.array().cast(j.schema["gs"].dataType)), lambda t: ~F.array_contains(acc["used"], t["b"]["id"]))
        scored = F.transform(free, lambda t: F.struct(_iou(x["b"], t["b"]).alias("v"), t["o"].alias("o")))
        best = F.array_max(F.filter(scored, lambda s: s["v"] >= F.col("thr")))["o"]
        return F.struct(F.when(best.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], best)).alias("used"), F.concat(acc["got"], F.array(F.coalesce(best, none))).alias("got"))

    done = j.withColumn("got", F.aggregate("ps", start, take, lambda a: a["got"]))
    out = done.select("image_id", "label", "thr", F.explode(F.arrays_zip("ps", "got")).alias("x"))
    return out.select("image_id", "label", "thr", F.col("x.ps.o").alias("pred_id"), F.col("x.ps.b.conf").alias("conf"), F.col("x.got").alias("gt_id"))


def average_precision(matched: DataFrame, gt: DataFrame, parts: int = 1024) -> DataFrame:
    """thr, label, n_gt, n_pred, ap: all-point average precision, rounded to four digits, of truth and predicted classes alike.

    The predictions of a class are cut in ``parts`` ranges of confidence. Ranks, hits and the precision envelope are windows
    inside a range plus what the ranges before it counted, and the best precision of the ranges after it, so a class of any
    number of predictions is many tasks' work.
    """
    n_gt = gt.groupBy("label").agg(F.count(F.lit(1)).alias("n_gt"))
    part = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("conf", F.lit(0.0)))) * parts).alias("part")
    key = ["thr", "label", "part"]
    pts = matched.select("thr", "label", part, "conf", "image_id", "pred_id", F.col("gt_id").isNotNull().cast("int").alias("hit"))
    order = Window.partitionBy(*key).orderBy(F.desc("conf"), "image_id", "pred_id").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("thr", "label").orderBy("part")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    counts = pts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    counts = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("tp0"))
    pts = pts.select(*key, "hit", F.count(F.lit(1)).over(order).alias("rn"), F.sum("hit").over(order).alias("tp"))
    pts = pts.join(counts, key).select(*key, "hit", (F.col("rn") + F.col("n0")).alias("rn"), (F.col("tp") + F.col("tp0")).alias("tp"))
    pts = pts.withColumn("precision", F.col("tp") / F.col("rn"))
    right = Window.partitionBy(*key).orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("thr", "label").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    best = pts.groupBy(*key).agg(F.max("precision").alias("best")).select(*key, F.max("best").over(after).alias("later"))
    pts = pts.withColumn("env", F.max("precision").over(right)).join(best, key).join(n_gt, "label", "left")
    # recall moves at hits only, by one truth
    step = F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt") - (F.col("tp") - F.col("hit")) / F.col("n_gt")).otherwise(F.lit(0.0))
    ap = pts.groupBy("thr", "label").agg(F.round(F.sum(F.greatest("env", F.coalesce("later", F.lit(0.0))) * step), 4).alias("ap"), F.count(F.lit(1)).alias("n_pred"))
    grid = n_gt.join(F.broadcast(matched.select("thr").distinct()))
    full = grid.join(ap, ["thr", "label"], "full_outer")
    return full.select("thr", "label", F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_ap(aps: DataFrame) -> DataFrame:
    """thr, n_classes, map: the mean of the rounded class values; predicted-only classes count as 0."""
    return aps.groupBy("thr").agg(F.count(F.lit(1)).alias("n_classes"), F.round(F.avg("ap"), 4).alias("map"))


def loc_gap(maps: DataFrame) -> DataFrame:
    """One row: mAP at 0.5 less mAP at 0.75."""
    at = lambda t: F.max(F.when(F.col("thr") == t, F.col("map")))
    return maps.agg(F.round(at(0.5) - at(0.75), 4).alias("loc_gap"))


def unmatched(gt: DataFrame, matched: DataFrame) -> DataFrame:
    """Truths that no prediction took, per threshold."""
    used = matched.where("gt_id is not null").select("image_id", "gt_id", "thr")
    grid = gt.join(F.broadcast(matched.select("thr").distinct()))
    return grid.join(used, ["image_id", "gt_id", "thr"], "left_anti")


def false_negatives(gt: DataFrame, pred: DataFrame, matched: DataFrame, loc_band: float = 0.1) -> DataFrame:
    """image_id, gt_id, label, thr, type: classification, localization or missed, in that order of precedence."""
    miss = unmatched(gt, matched)
    p = pred.select("image_id", F.col("label").alias("pl"), *[F.col(c).alias(f"p_{c}") for c in ("cx", "cy", "w", "h")])
    v = C.iou(C.box("p_"), C.box())
    j = miss.join(p, "image_id", "left").withColumn("v", v)
    cls = F.max(((F.col("pl") != F.col("label")) & (F.col("v") >= F.col("thr"))).cast("int"))
    loc = F.max(((F.col("pl") == F.col("label")) & (F.col("v") >= loc_band) & (F.col("v") < F.col("thr"))).cast("int"))
    out = j.groupBy("image_id", "gt_id", "label", "thr").agg(cls.alias("c"), loc.alias("l"))
    return out.select("image_id", "gt_id", "label", "thr", F.when(F.col("c") == 1, "classification").when(F.col("l") == 1, "localization").otherwise("missed").alias("type"))


def _fp_pairs(gt: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    fp = matched.where("gt_id is null").select("image_id", "pred_id", "thr", F.col("label").alias("pl"), "conf")
    boxes = pred.select("image_id", "pred_id", *[F.col(c).alias(f"p_{c}") for c in ("cx", "cy", "w", "h")])
    miss = unmatched(gt, matched)
    j = fp.join(boxes, ["image_id", "pred_id"]).join(miss, ["image_id", "thr"], "left")
    return j.withColumn("v", C.iou(C.box("p_"), C.box()))


def false_positives(gt: DataFrame, pred: DataFrame, matched: DataFrame, loc_band: float = 0.1) -> DataFrame:
    """image_id, pred_id, label, thr, conf, type: background, or paired with a false negative that reports it."""
    j = _fp_pairs(gt, pred, matched)
    other = (F.col("label") != F.col("pl")) & (F.col("v") >= F.col("thr"))
    loose = (F.col("label") == F.col("pl")) & (F.col("v") >= loc_band) & (F.col("v") < F.col("thr"))
    out = j.groupBy("image_id", "pred_id", "pl", "thr", "conf").agg(F.coalesce(F.max((other | loose).cast("int")), F.lit(0)).alias("paired"))
    return out.select("image_id", "pred_id", F.col("pl").alias("label"), "thr", F.round("conf", 4).alias("conf"), F.when(F.col("paired") == 1, "paired").otherwise("background").alias("type"))


def confusion(gt: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """truth, pred, thr, n: each false positive against the first unmatched truth of another class that it covers."""
    j = _fp_pairs(gt, pred, matched).where((F.col("label") != F.col("pl")) & (F.col("v") >= F.col("thr")))
    first = j.groupBy("image_id", "pred_id", "pl", "thr").agg(F.min_by("label", "gt_id").alias("truth"))
    return first.groupBy("truth", F.col("pl").alias("pred"), "thr").agg(F.count(F.lit(1)).alias("n"))


def per_image(gt: DataFrame, matched: DataFrame) -> DataFrame:
    """image_id, thr, n_fp, n_fn of every image with a truth or a prediction."""
    fp = matched.groupBy("image_id", "thr").agg(F.count_if(F.col("gt_id").isNull()).alias("n_fp"))
    fn = unmatched(gt, matched).groupBy("image_id", "thr").agg(F.count(F.lit(1)).alias("n_fn"))
    every = gt.select("image_id").distinct().join(F.broadcast(matched.select("thr").distinct())).unionByName(matched.select("image_id", "thr")).distinct()
    out = every.join(fp, ["image_id", "thr"], "left").join(fn, ["image_id", "thr"], "left")
    return out.select("image_id", "thr", F.coalesce("n_fp", F.lit(0)).alias("n_fp"), F.coalesce("n_fn", F.lit(0)).alias("n_fn"))


def rank_false_positives(fps: DataFrame, top: int = 50) -> DataFrame:
    """Background false positives, most confident first."""
    return fps.where("type = 'background' and conf is not null").select("image_id", "pred_id", F.col("label").alias("pred_class"), "conf").orderBy(F.desc("conf"), "image_id", "pred_id").limit(top)


def diagnose(gt: DataFrame, pred: DataFrame, loc_iou: float = 0.5, min_overlap: float = 0.1) -> DataFrame:
    """image_id, gt_id, verdict by the best overlapping prediction of any class: ok, classification_error, localization_error, missed."""
    p = pred.select("image_id", "pred_id", F.col("label").alias("pl"), *[F.col(c).alias(f"p_{c}") for c in ("cx", "cy", "w", "h")])
    j = gt.join(p, "image_id", "left").withColumn("v", C.iou(C.box("p_"), C.box()))
    w = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("v"), "pred_id")
    best = j.withColumn("r", F.row_number().over(w)).where("r = 1")
    verdict = F.when(F.coalesce("v", F.lit(0.0)) < min_overlap, "missed").when(F.col("v") >= loc_iou, F.when(F.col("pl") == F.col("label"), "ok").otherwise("classification_error")).otherwise("localization_error")
    return best.select("image_id", "gt_id", verdict.alias("verdict"))


def weakest(aps: DataFrame, misses: DataFrame, mistaken: DataFrame) -> DataFrame:
    """label, ap, dominant_fn, n_fn, confused_with of classes, lowest value first: how each is missed, and for what."""
    kinds = misses.groupBy("label", "type").agg(F.count(F.lit(1)).alias("k")).groupBy("label").agg(F.max_by("type", F.struct("k", "type")).alias("dominant_fn"), F.sum("k").alias("n_fn"))
    partner = mistaken.groupBy(F.col("truth").alias("label")).agg(F.max_by("pred", F.struct("n", "pred")).alias("confused_with"))
    return aps.select("label", "ap").join(kinds, "label", "left").join(partner, "label", "left").orderBy("ap", "label")


def eval_set_hash(gt: DataFrame) -> DataFrame:
    """One row, hash: 16 hex digits over the images and their sorted truths; predictions play no part.

    Per-image digests are combined by their sorted list, so the driver never sees a box.
    """
    line = F.concat_ws(",", "label", *[F.format_string("%.6f", F.col(c)) for c in ("cx", "cy", "w", "h")])
    per = gt.groupBy("image_id").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256).alias("d"))
    part = per.select(F.concat_ws(":", F.col("image_id").cast("string"), "d").alias("x"), F.substring("d", 1, 2).alias("b"))
    shard = part.groupBy("b").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("x"))), 256).alias("s"))
    return shard.agg(F.substring(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat("b", "s")))), 256), 1, 16).alias("hash"))


def freeze_baseline(aps: DataFrame, eval_hash: DataFrame, protected: dict[str, float] | None = None, map_drop: float = 0.02) -> DataFrame:
    """label, ap, n_gt, allowed, map, eval_set_hash, map_drop: an evaluation as the bar that later ones are held to.

    ``allowed`` is the drop that a protected class may show, null for the others.
    """
    whole = aps.agg(F.round(F.avg("ap"), 4).alias("map")).join(F.broadcast(eval_hash.select(F.col("hash").alias("eval_set_hash"))))
    allowed = F.lit(None).cast("double")
    for label, drop in (protected or {}).items():
        allowed = F.when(F.col("label") == label, F.lit(float(drop))).otherwise(allowed)
    return aps.select("label", "ap", "n_gt", allowed.alias("allowed")).join(F.broadcast(whole)).withColumn("map_drop", F.lit(map_drop))


def check_baseline(current: DataFrame, support: DataFrame, baseline: DataFrame, eval_hash: str | None = None, min_support: int = 20) -> DataFrame:
    """What ``regression_check`` says of current values against a frozen baseline; another evaluation set is only an advice."""
    rows = baseline.select("label", "allowed", "map_drop", "eval_set_hash").collect()  # one row a class
    guard = {r.label: r.allowed for r in rows if r.allowed is not None}
    changed = bool(rows) and eval_hash is not None and rows[0].eval_set_hash != eval_hash
    return regression_check(current, baseline, support, guard, rows[0].map_drop if rows else 0.02, min_support, changed)


def regression_check(current: DataFrame, baseline: DataFrame, support: DataFrame, protected: dict[str, float] | None = None, map_drop: float = 0.02, min_support: int = 20, set_changed: bool = False) -> DataFrame:
    """kind (blocking, advisory), label, reason, drop of two tables (label, ap): fail-closed on protected classes."""
    spark = current.sparkSession
    if set_changed:
        return spark.createDataFrame([("advisory", None, "eval_set_changed", None)], "kind string, label string, reason string, drop double")
    j = baseline.select("label", F.col("ap").alias("was")).join(current.select("label", F.col("ap").alias("now")), "label", "full_outer").join(support.select("label", F.col("n").alias("n")), "label", "left")
    total = j.agg(F.round(F.round(F.avg("was"), 4) - F.round(F.avg("now"), 4), 4).alias("drop")).where(F.col("drop") > map_drop).select(F.lit("blocking").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit("map_drop").alias("reason"), "drop")
    prot = protected or {}
    p = spark.createDataFrame(list(prot.items()) or [("", 0.0)], "label string, allowed double").where("label <> ''")
    k = p.join(j, "label", "left").withColumn("drop", F.round(F.coalesce("was", F.lit(0.0)) - F.coalesce("now", F.lit(0.0)), 4))
    weak = F.coalesce("n", F.lit(0)) < min_support
    blocked = k.withColumn("reason", F.when(weak, "protected_support").when(F.col("drop") > F.col("allowed"), "protected_drop")).where("reason is not null")
    blocked = blocked.select(F.lit("blocking").alias("kind"), "label", "reason", F.when(~weak, F.col("drop")).alias("drop"))
    few = j.join(p, "label", "left_anti").where(weak).select(F.lit("advisory").alias("kind"), "label", F.lit("small_support").alias("reason"), F.lit(None).cast("double").alias("drop"))
    return total.unionByName(blocked).unionByName(few)
