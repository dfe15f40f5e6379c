"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column) -> Column:
    """v / (|v| + 1e-12); a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(EPS)
    return F.transform(v, lambda x: x / norm)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two centre boxes (cx, cy, w, h); 0 where the union has no area."""
    def edge(box, k, side):
        return box[k] + box[k + 2] * F.lit(side / 2)

    width = F.greatest(F.lit(0.0), F.least(edge(a, 0, 1), edge(b, 0, 1)) - F.greatest(edge(a, 0, -1), edge(b, 0, -1)))
    height = F.greatest(F.lit(0.0), F.least(edge(a, 1, 1), edge(b, 1, 1)) - F.greatest(edge(a, 1, -1), edge(b, 1, -1)))
    inter = width * height
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("cx", "cy", "w", "h"))


def clip(p: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def temperature(p: Column, t: Column | float) -> Column:
    """sigmoid(logit(p) / t), p clipped into (0, 1)."""
    c = clip(p)
    t = F.greatest(t if isinstance(t, Column) else F.lit(float(t)), F.lit(1e-6))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(c / (F.lit(1.0) - c)) / t)))


def reasons(*flags: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in flags]))


def finite(x: Column) -> Column:
    """Null for an infinite or undefined number, as JSON wants it."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(None)).otherwise(x)


def tagged(tags: Column, any_of: list[str], none_of: list[str] = ()) -> Column:
    """Rows with one of ``any_of`` (any row, if empty) and none of ``none_of``."""
    cond = F.lit(True) if not any_of else F.arrays_overlap(tags, F.array(*map(F.lit, any_of)))
    return cond if not none_of else cond & ~F.arrays_overlap(tags, F.array(*map(F.lit, none_of)))


def namespace(tags: Column, prefix: str, last: bool = True) -> Column:
    """Value of the last (or first) tag ``prefix:value``, empty without one."""
    found = F.filter(tags, lambda t: F.startswith(t, F.lit(f"{prefix}:")))
    pick = F.element_at(found, -1 if last else 1)
    return F.when(F.size(found) > 0, F.substring(pick, len(prefix) + 2, 1 << 20)).otherwise(F.lit(""))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k of n; (0, 1) without trials."""
    p, zz = k / n, F.lit(z * z)
    down = F.lit(1.0) + zz / n
    mid = p + zz / (F.lit(2.0) * n)
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (F.lit(4.0) * n * n))
    low = F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (mid - half) / down))
    high = F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (mid + half) / down))
    return low, high


def k_rule(n: Column) -> Column:
    """max(3, floor(sqrt(n))), made odd."""
    k = F.greatest(F.lit(3), F.floor(F.sqrt(F.greatest(F.lit(1), n))).cast("int"))
    return F.when(k % 2 == 1, k).otherwise(k + 1)


def support_tier(n_min: Column, n_pair: Column) -> Column:
    return F.when((n_min < 10) | (n_pair < 25), "insufficient_support").when(n_min < 20, "provisional").otherwise("supported")
