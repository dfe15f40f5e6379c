"""Go / no-go verdicts, status, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def pre_train(checks: DataFrame) -> DataFrame:
    """One row of checks to verdict and reasons.

    Columns: n_golden, eval_golden_overlap, backend_mixed, n_review_open, golden_train_overlap, under_represented (array),
    drift_triggered, chain_intact, and extra (array of blocking reasons).
    """
    flags = C.reasons(
        (F.col("n_golden") == 0, "no_golden"),
        (F.col("eval_golden_overlap") > 0, "eval_golden_overlap"),
        (F.col("backend_mixed"), "backend_mixed"),
        (F.col("n_review_open") > 0, "review_open"),
        (F.col("golden_train_overlap") > 0, "golden_train_overlap"),
        (F.size("under_represented") > 0, "under_represented"),
        (F.col("drift_triggered"), "drift"),
        (~F.col("chain_intact"), "chain_broken"),
    )
    out = checks.withColumn("reasons", F.concat(flags, F.col("extra")))
    return out.withColumn("verdict", F.when(F.size("reasons") == 0, "GO").otherwise("NO-GO"))


def checks(samples: DataFrame, under: DataFrame, leaks: DataFrame, backends: DataFrame, guard: DataFrame, chain: DataFrame, extra: list[str] = ()) -> DataFrame:
    """The one row that ``pre_train`` judges, from the things themselves.

    samples (tags); under-represented classes (label); leaking groups (splits, an array); the embedding backends in use
    (backend); a drift guard (triggered); checked ledger lines (link_ok, hash_ok). Empty tables raise no flag.
    """
    golden, evals = (F.array_contains("tags", t) for t in ("golden", "eval"))
    one = samples.agg(F.count_if(golden).alias("n_golden"), F.count_if(golden & evals).alias("eval_golden_overlap"), F.count_if(F.array_contains("tags", "review")).alias("n_review_open"))
    parts = [
        under.agg(F.array_sort(F.collect_list("label")).alias("under_represented")),
        leaks.agg(F.count_if(F.array_contains("splits", "golden") & F.array_contains("splits", "train")).alias("golden_train_overlap")),
        backends.agg((F.count_distinct("backend") > 1).alias("backend_mixed")),
        guard.agg(F.coalesce(F.max("triggered"), F.lit(False)).alias("drift_triggered")),
        chain.agg(F.coalesce(F.min(F.col("link_ok") & F.col("hash_ok")), F.lit(True)).alias("chain_intact")),
    ]
    for x in parts:
        one = one.join(F.broadcast(x))  # one row each
    return one.withColumn("extra", F.array(*map(F.lit, extra)).cast("array<string>"))


def flagged_planned(planned: DataFrame, flagged: DataFrame) -> DataFrame:
    """The planned ids that are flagged."""
    return planned.select("id").distinct().join(flagged.select("id"), "id", "left_semi")


def batch_verdict(counts: DataFrame) -> DataFrame:
    """batch, n_block, n_clean, eval_available to verdict: BLOCK over PARTIAL over CLEAN over PASS."""
    v = F.when(F.col("n_block") > 0, "BLOCK").when(~F.col("eval_available"), "PARTIAL").when(F.col("n_clean") > 0, "CLEAN").otherwise("PASS")
    return counts.withColumn("verdict", v)


def weakness_health(one: DataFrame) -> DataFrame:
    """Health of a model from map, n_confident_wrong and worst_ap: RED, AMBER or GREEN."""
    red = (F.col("map") < 0.3) | (F.col("worst_ap") < 0.1)
    amber = (F.col("map") < 0.6) | (F.col("worst_ap") < 0.4) | (F.col("n_confident_wrong") > 0)
    return one.withColumn("health", F.when(red, "RED").when(amber, "AMBER").otherwise("GREEN"))


def status(samples: DataFrame) -> DataFrame:
    """One row of counts by tag, and the next step: samples (hash, tags, n_dets, has_embedding)."""
    has = lambda t: F.array_contains("tags", t)
    one = samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_dets") > 0).alias("detected"), F.count_if("has_embedding").alias("embedded"), F.count_if(has("golden")).alias("golden"), F.count_if(has("review")).alias("review"), F.count_if(has("pass")).alias("pass"), F.count_if(has("rejected")).alias("rejected"))
    step = F.when(F.col("n") == 0, "ingest").when(F.col("detected") == 0, "infer").when(F.col("embedded") == 0, "embed").when(F.col("golden") == 0, "confirm_golden").when(F.col("review") + F.col("pass") == 0, "calibrate_and_route").when(F.col("review") > 0, "review").otherwise("gate")
    return one.withColumn("next_step", step)


def health(n: int | DataFrame, *parts: DataFrame) -> DataFrame:
    """Quality score of one-row frames that hold n, redundant, n_review, n_issues, n_under."""
    one = n
    for p in parts:
        one = one.join(F.broadcast(p))
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(0.0))
    one = one.withColumn("dup_rate", rate("redundant")).withColumn("review_ratio", rate("n_review")).withColumn("label_rate", rate("n_issues"))
    score = F.round(F.lit(100.0) - 30 * F.col("dup_rate") - 30 * F.col("label_rate") - 20 * F.col("review_ratio") - 5 * F.col("n_under"), 1)
    return one.withColumn("quality", F.greatest(F.lit(0.0), score))


def suggestions(one: DataFrame) -> DataFrame:
    """kind, magnitude of a health row's problems, largest first."""
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("magnitude")) for k, c in (("duplicates", "dup_rate"), ("label_errors", "label_rate"), ("open_review", "review_ratio"))])).alias("s"))
    return rows.select("s.*").where("magnitude > 0").orderBy(F.desc("magnitude"), "kind")


def report_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """label, change (new, removed) between the class lists of two reports."""
    a, b = before.select("label").distinct(), after.select("label").distinct()
    return b.subtract(a).withColumn("change", F.lit("new")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))
