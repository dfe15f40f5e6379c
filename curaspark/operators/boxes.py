"""Box quality: geometry checks, tightness, non-maximum suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

SEVERITY = ("degenerate", "truncated", "area_outlier", "aspect_outlier")


def audit(boxes: DataFrame, area_eps: float = 1e-4, lin_eps: float = 1e-3, edge_eps: float = 1e-3, min_support: int = 8, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """id, label, issue, severity of boxes (id, label, cx, cy, w, h); one issue each, the most severe.

    Class envelopes are percentiles over all boxes of classes with enough of them, bad boxes included.
    """
    b = boxes.withColumn("area", F.col("w") * F.col("h")).withColumn("aspect", F.when(F.col("h") > 0, F.col("w") / F.col("h")))
    pct = lambda c, p: F.expr(f"percentile({c}, {p})")
    env = b.groupBy("label").agg(F.count(F.lit(1)).alias("n"), pct("area", lo).alias("a_lo"), pct("area", hi).alias("a_hi"), pct("aspect", lo).alias("r_lo"), pct("aspect", hi).alias("r_hi")).where(F.col("n") >= min_support)
    j = b.join(env, "label", "left")
    degenerate = (F.col("area") < area_eps) | (F.col("w") < lin_eps) | (F.col("h") < lin_eps)
    edge = (F.col("cx") - F.col("w") / 2 <= edge_eps) | (F.col("cy") - F.col("h") / 2 <= edge_eps) | (F.col("cx") + F.col("w") / 2 >= 1 - edge_eps) | (F.col("cy") + F.col("h") / 2 >= 1 - edge_eps)
    area = (F.col("area") < F.col("a_lo")) | (F.col("area") > F.col("a_hi"))
    aspect = (F.col("aspect") < F.col("r_lo")) | (F.col("aspect") > F.col("r_hi"))
    issue = F.when(degenerate, "degenerate").when(edge, "truncated").when(area, "area_outlier").when(aspect, "aspect_outlier")
    out = j.withColumn("issue", issue).where("issue is not null")
    severity = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("issue")).cast("int") - 1
    return out.select("id", "label", "issue", severity.alias("severity")).orderBy("severity", "id")


def tightness(boxes: DataFrame, masks: DataFrame, threshold: float = 0.6, limit: int | None = None) -> DataFrame:
    """id, iou of boxes against the boxes of their masks, loosest first, where below the threshold."""
    m = masks.select("id", *[F.col(c).alias(f"m_{c}") for c in ("cx", "cy", "w", "h")])
    out = boxes.join(m, "id").select("id", C.iou(C.box(), C.box("m_")).alias("iou")).where(F.col("iou") < threshold).orderBy(F.round("iou", 9), "id")
    return out if limit is None else out.limit(limit)


def loose_nms(dets: DataFrame, iou_thr: float = 0.7, key: str = "image_id") -> DataFrame:
    """Detections (key, pred_id, conf, box) that class-agnostic greedy suppression keeps.

    The fold over one image's detections, most confident first, carries the boxes kept so far.
    """
    one = F.struct((-F.col("conf")).alias("neg"), "pred_id", "cx", "cy", "w", "h", "conf")
    g = dets.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("ds"))

    def step(acc, d):
        hit = F.exists(acc, lambda a: C.iou(tuple(a[c] for c in ("cx", "cy", "w", "h")), tuple(d[c] for c in ("cx", "cy", "w", "h"))) >= iou_thr)
        return F.when(hit, acc).otherwise(F.array_append(acc, d))

    kept = g.withColumn("kept", F.aggregate("ds", F.array().cast(g.schema["ds"].dataType), step))
    return kept.select(key, F.explode("kept").alias("d")).select(key, "d.pred_id", "d.conf", "d.cx", "d.cy", "d.w", "d.h")


def corners(xmin, ymin, xmax, ymax, width, height):
    """Pixel corners as a normalised centre box."""
    return ((xmin + xmax) / 2 / width, (ymin + ymax) / 2 / height, (xmax - xmin) / width, (ymax - ymin) / height)


def from_top_left(x, y, w, h):
    """Normalised top-left box as a centre box."""
    return (x + w / 2, y + h / 2, w, h)
