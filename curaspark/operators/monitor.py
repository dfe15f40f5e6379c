"""Control charts and confidence calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def series(rows: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """by..., xs: the values of each series in order. A series is a chart's points, one a batch."""
    one = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return rows.groupBy(*by).agg(one.alias("xs"))


def ewma(xs: Column, lam: float = 0.3) -> Column:
    """Exponentially weighted means, started at the first value."""
    first = F.element_at(xs, 1)
    none = F.array().cast("array<double>")
    step = lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, lam * x + (1 - lam) * first).otherwise(lam * x + (1 - lam) * F.element_at(acc, -1)))
    return F.when(F.size(xs) > 0, F.aggregate(xs, none, step)).otherwise(none)


def ewma_alarm(xs: Column, target: Column, sigma: Column, lam: float = 0.3, width: float = 3.0) -> Column:
    """First position (from 0) at which the weighted mean leaves target +- width sigma sqrt(lam / (2 - lam)); null if none."""
    half = F.lit(width) * sigma * F.lit((lam / (2 - lam)) ** 0.5)
    out = F.transform(ewma(xs, lam), lambda z: (z > target + half) | (z < target - half))
    at = F.array_position(out, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def cusum_alarm(xs: Column, target: Column, k: Column, h: Column) -> Column:
    """Struct (s_pos, s_neg, alarm_index) of a two-sided cumulative sum, stopped at its first alarm."""
    zero = F.struct(F.lit(0.0).alias("s_pos"), F.lit(0.0).alias("s_neg"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("alarm_index"))

    def step(acc, x):
        up = F.greatest(F.lit(0.0), acc["s_pos"] + (x - target) - k)
        down = F.greatest(F.lit(0.0), acc["s_neg"] + (target - x) - k)
        stop = acc["alarm_index"].isNotNull()
        alarm = F.when((up > h) | (down > h), acc["i"])
        return F.struct(F.when(stop, acc["s_pos"]).otherwise(up).alias("s_pos"), F.when(stop, acc["s_neg"]).otherwise(down).alias("s_neg"), (acc["i"] + 1).alias("i"), F.when(stop, acc["alarm_index"]).otherwise(alarm).alias("alarm_index"))

    return F.aggregate(xs, zero, step)


def spc(charts: DataFrame) -> DataFrame:
    """xs to n, target, sigma, ewma_index, cusum_index, short: baseline of the first max(3, n / 4) points."""
    n = F.size("xs")
    base = F.slice("xs", 1, F.greatest(F.lit(3), F.floor(n / 4).cast("int")))
    b = charts.withColumn("n", n).withColumn("b", F.array_sort(base))
    m = F.size("b")
    mid = (F.element_at("b", F.floor((m + 1) / 2).cast("int")) + F.element_at("b", F.floor(m / 2).cast("int") + 1)) / 2
    mean = F.aggregate("b", F.lit(0.0), lambda s, x: s + x) / m
    var = F.aggregate("b", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / m
    b = b.where("n > 0").withColumn("target", mid).withColumn("sigma", F.when(var > 0, F.sqrt(var)).otherwise(F.lit(1e-6)))
    t, s = F.col("target"), F.col("sigma")
    return b.withColumn("ewma_index", ewma_alarm(F.col("xs"), t, s)).withColumn("cusum_index", cusum_alarm(F.col("xs"), t, 0.5 * s, 4 * s)["alarm_index"]).withColumn("short", F.col("n") < 8).drop("b", "xs")


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row, ece, of (conf, correct): bins are (lo, hi] with edges i * (1 / bins)."""
    c = rows.select(C.clip(F.col("conf")).alias("c"), F.col("correct").cast("double").alias("y"))
    edge = lambda i: i * (1.0 / bins)
    bin_ = F.lit(0)
    for i in range(1, bins):
        bin_ = F.when(F.col("c") > edge(i), F.lit(i)).otherwise(bin_)
    g = c.withColumn("bin", bin_).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("c"), F.avg("y").alias("y"))
    return g.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("y"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def fit_temperature(rows: DataFrame, lo: float = 0.05, hi: float = 10.0, steps: int = 60, ahead: int = 6) -> DataFrame:
    """One row, temperature: ternary search of the mean negative log likelihood.

    Rows are first summed to one per distinct confidence; each pass over that table serves the next ``ahead`` steps: it meets
    the 2 ** (ahead + 1) points, a fixed number, that those steps could ask for.
    """
    g = rows.groupBy(C.clip(F.col("conf")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("double")).alias("y")).persist()
    spark = rows.sparkSession
    try:
        if g.isEmpty():
            return spark.createDataFrame([(1.0,)], "temperature double")

        p = C.clip(C.temperature(F.col("c"), F.col("t")))
        loss = -F.sum(F.col("y") * F.log(p) + (F.col("n") - F.col("y")) * F.log(1 - p)) / F.sum("n")

        # a pass evaluates the probes of every interval that the next ``ahead`` steps could reach
        while steps > 0:
            reach = {"": (lo, hi)}
            for depth in range(min(ahead, steps) - 1):
                for path in [p for p in reach if len(p) == depth]:
                    x, y = reach[path]
                    reach[path + "l"], reach[path + "r"] = (x, y - (y - x) / 3), (x + (y - x) / 3, y)
            probes = [(p, side, t) for p, (x, y) in reach.items() for side, t in (("a", x + (y - x) / 3), ("b", y - (y - x) / 3))]
            rows = spark.createDataFrame(probes, "path string, side string, t double")
            value = {(r.path, r.side): r.loss for r in g.crossJoin(F.broadcast(rows)).groupBy("path", "side").agg(loss.alias("loss")).collect()}
            path = ""
            while path in reach:
                x, y = reach[path]
                left = value[path, "a"] < value[path, "b"]
                lo, hi = (x, y - (y - x) / 3) if left else (x + (y - x) / 3, y)
                path += "l" if left else "r"
                steps -= 1
        return spark.createDataFrame([(round((lo + hi) / 2, 4),)], "temperature double")
    finally:
        g.unpersist()


def cost_gate(rates: DataFrame, miss_cost: float, fa_cost: float, budget: float) -> DataFrame:
    """Adds expected_cost, miss_component, fa_component and verdict to rows of (miss_rate, fa_rate); a cost equal to the budget is GO."""
    miss, fa = F.col("miss_rate") * F.lit(float(miss_cost)), F.col("fa_rate") * F.lit(float(fa_cost))
    verdict = F.when(miss + fa <= F.lit(float(budget)), "GO").otherwise("NO-GO")
    return rates.select("*", F.round(miss + fa, 4).alias("expected_cost"), F.round(miss, 4).alias("miss_component"), F.round(fa, 4).alias("fa_component"), verdict.alias("verdict"))
