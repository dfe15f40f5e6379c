"""The one-stop run: steps in order, stopping at the first that fails, every result kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, dedup, gates, graph, labels, routing
from ..sources import files


@dataclass
class Run:
    done: list[str] = field(default_factory=list)
    results: dict[str, object] = field(default_factory=dict)
    failed: str | None = None
    error: str | None = None


def steps(plan: list[tuple[str, Callable[[Run], object]]]) -> Run:
    """Run named steps; each sees the results so far."""
    run = Run()
    for name, step in plan:
        try:
            run.results[name] = step(run)
        except Exception as e:  # noqa: BLE001
            run.failed, run.error = name, f"{type(e).__name__}: {e}"
            break
        run.done.append(name)
    return run


def curate(samples: DataFrame, max_distance: float = 0.05, k: int = 10) -> Run:
    """Calibrate, route, find duplicates, label errors and leakage, and gate: samples are (hash, tags, dets)."""
    golden = files.detection_items(samples, ["golden"])
    items = files.detection_items(samples)
    rest = samples.where(~F.arrays_overlap("tags", F.array(*map(F.lit, ("golden", "anchor", "eval")))))

    def route(run: Run) -> DataFrame:
        scored = routing.score_detections(files.detection_items(rest), golden, k)
        return graph.cut(routing.route_images(rest.select("hash"), routing.route(scored, run.results["calibrate"])))

    def gate(run: Run) -> DataFrame:
        under = coverage.coverage_gaps(golden).where("under_represented").agg(F.array_sort(F.collect_list("label")).alias("under_represented"))
        n = samples.agg(F.count_if(F.array_contains("tags", "golden")).alias("n_golden"), F.count_if(F.arrays_overlap("tags", F.array(F.lit("eval"))) & F.array_contains("tags", "golden")).alias("eval_golden_overlap"))
        open_ = run.results["route"].agg(F.count_if(F.col("decision") == "review").alias("n_review_open"))
        leak = run.results["leakage"].agg(F.count(F.lit(1)).alias("golden_train_overlap"))
        one = n.join(F.broadcast(under)).join(F.broadcast(open_)).join(F.broadcast(leak))
        flags = one.select("*", F.lit(False).alias("backend_mixed"), F.lit(False).alias("drift_triggered"), F.lit(True).alias("chain_intact"), F.array().cast("array<string>").alias("extra"))
        return gates.pre_train(flags)

    return steps(
        [
            ("calibrate", lambda run: graph.cut(routing.calibrate(golden, k))),
            ("route", route),
            ("dedup", lambda run: graph.cut(dedup.groups(items, max_distance))),
            ("audit_labels", lambda run: graph.cut(labels.suspected_errors(golden, k))),
            ("leakage", lambda run: graph.cut(dedup.leakage(items, max_distance))),
            ("gate", gate),
        ]
    )
