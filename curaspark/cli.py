"""Command line over a workspace folder: samples (Parquet), ledger.jsonl, thresholds.json, evaluation files.

``python -m curaspark.cli WORKSPACE VERB [--option value ...]`` prints the verb's table; gates end with status 2 unless they pass.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import bank, boxes, coverage, dedup, drift, evaluation, export, gates, graph, labels, ledger, monitor, review, routing, vectors
from .plans import run as runs
from .sources import files


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    @property
    def samples(self) -> DataFrame:
        """hash, src_path, tags, dets (label, confidence, cx, cy, w, h, embedding): as ingested, with tag events folded in."""
        base = self.spark.read.parquet(self.path("samples"))
        if not os.path.exists(self.path("tag_events")):
            return base
        return base.drop("tags").join(review.fold_tags(base, self.events), "hash").select(*base.columns)

    @property
    def events(self) -> DataFrame:
        return self.spark.read.schema("hash string, tag string, op string, seq long").json(self.path("tag_events"))

    def tag(self, events: DataFrame, **record) -> DataFrame:
        """Append tag events after those there are, log it, and return them."""
        last = (self.events.agg(F.max("seq")).first()[0] or 0) + 1 if os.path.exists(self.path("tag_events")) else 0
        new = graph.cut(events.withColumn("seq", F.col("seq") + last))
        files.append_lines(new, self.path("tag_events"))
        self.log(**record)
        return new.drop("seq")

    def log(self, event: str, **fields) -> None:
        stamp = datetime.datetime.now(datetime.timezone.utc).isoformat()
        extra = {k: json.dumps(v, ensure_ascii=False) if k == "extra" else v for k, v in fields.items() if v is not None}
        ledger.append(self.spark, self.path("ledger.jsonl"), [{"event": event, "ts_utc": stamp, **extra}])

    def ids(self, text: str) -> DataFrame:
        """Comma-separated ids, all of which must be known."""
        ids = self.spark.createDataFrame([(x,) for x in text.split(",") if x], "hash string")
        if (lost := review.unknown_ids(self.samples, ids).limit(5).collect()):
            raise ValueError(f"unknown ids: {[r.hash for r in lost]}")
        return ids

    def scored(self, k: int) -> DataFrame:
        return routing.score_detections(self.items("", "golden"), self.items("golden"), k)

    def table(self, row: dict) -> DataFrame:
        return self.spark.createDataFrame([tuple(row.values())], list(row))

    def items(self, any_of: str = "", none_of: str = "") -> DataFrame:
        pick = [files.resolve_tag(self.samples, t) for t in any_of.split(",") if t]
        return files.detection_items(self.samples, pick, [t for t in none_of.split(",") if t])

    @property
    def ledger(self) -> DataFrame:
        return files.read_ledger(self.spark, self.path("ledger.jsonl")).withColumn("ts", F.to_timestamp("ts_utc")).withColumn("reasons", F.coalesce(F.from_json(F.get_json_object("extra", "$.reasons"), "array<string>"), F.array().cast("array<string>")))

    @property
    def thresholds(self) -> DataFrame:
        return files.load_thresholds(self.spark, self.path("thresholds.json"))

    @property
    def boxes(self) -> DataFrame:
        return self.samples.select("hash", "src_path", "tags", F.posexplode("dets").alias("pos", "d")).select(F.concat_ws(":", "hash", "pos").alias("id"), "hash", "src_path", "tags", "pos", "d.label", "d.cx", "d.cy", "d.w", "d.h")

    def evaluation(self, path: str, thr: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        gt, pred = files.eval_tables(files.read_eval(self.spark, path))
        return gt, pred, evaluation.match(gt, pred, sorted({thr, 0.5, 0.75}))


def _calibrate(w: Workspace, a) -> DataFrame:
    t = graph.cut(routing.calibrate(w.items("golden"), a.k))
    files.save_thresholds(t, w.path("thresholds.json"), {"k": a.k})
    return t


def _routed(w: Workspace, a) -> DataFrame:
    scored = routing.score_detections(w.items("", "golden,anchor,eval"), w.items("golden"), a.k)
    fresh = w.samples.where(~C.tagged(F.col("tags"), ["golden", "anchor", "eval"])).select("hash")
    return routing.route_images(fresh, routing.route(scored, w.thresholds))


def _resolve(w: Workspace, a) -> DataFrame:
    decided = w.ids(a.id).withColumn("decision", F.lit(a.decision or ""))
    return w.tag(review.resolve(w.samples, decided), event="review", image_hash=a.id, decision=a.decision or "confirmed", reviewer_id=a.reviewer)


def _sync(w: Workspace, a) -> DataFrame:
    pulled = files.read_decisions(w.spark, a.path)
    return w.tag(review.resolve(w.samples, pulled), event="sync_reviews", decision=str(pulled.count()))


def _dismiss(op: str):
    return lambda w, a: w.tag(review.dismiss(w.ids(a.id), op=op), event="dismiss" if op == "remove" else "restore_dismissed", image_hash=a.id)


def _relabel(w: Workspace, a) -> DataFrame:
    """Renames (old=new, ...) into a log beside the samples, which stay as they are."""
    mapping = w.spark.createDataFrame(list(files.json_argument(a.map).items()), "old string, new string")
    _, changes = labels.relabel(w.items(a.tag), mapping)
    changes = graph.cut(changes.select(F.col("id").cast("string").alias("id"), "old", "new"))
    files.append_lines(changes, w.path("relabels"))
    w.log("relabel", decision=str(changes.count()))
    return labels.migration_diff(changes)


def _merge(w: Workspace, a) -> DataFrame:
    over = w.spark.createDataFrame(list((files.json_argument(a.map) if a.map else {}).items()), "old string, new string")
    return labels.merge_datasets(w.items(a.tag), w.items(a.other), over).orderBy("name")


def _preview(w: Workspace, a) -> DataFrame:
    over = w.spark.createDataFrame(list((files.json_argument(a.map) if a.map else {}).items()), "old string, new string")
    return labels.merged_distribution(w.items(a.tag), w.items(a.other), over).orderBy("label")


def _snapshot(w: Workspace, a) -> DataFrame:
    s = graph.cut(review.composition(w.samples.select(F.col("hash").alias("image_hash"), "tags"), ledger.latest_reasons(w.ledger)))
    s.write.mode("overwrite").parquet(w.path(f"snapshots/{a.id}"))
    digest = review.content_hash(s.where("included")).first().hash
    w.log("snapshot", decision=a.id, extra={"content_hash": digest})
    return s.groupBy("included").agg(F.count(F.lit(1)).alias("n"))


def _restore(w: Workspace, a) -> DataFrame:
    now = export.exportable(w.samples).select(F.col("hash").alias("image_hash"))
    todo = graph.cut(review.restore(now, w.spark.read.parquet(w.path(f"snapshots/{a.id}"))))
    event = todo.select(F.col("image_hash").alias("hash"), F.lit("golden").alias("tag"), F.when(F.col("action") == "add", "add").otherwise("remove").alias("op"), F.lit(0).cast("long").alias("seq"))
    w.tag(event, event="snapshot_restore", decision=a.id)
    return todo


def _health(w: Workspace, k: int, distance: float) -> DataFrame:
    i = w.items()
    n = w.samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("tags", "review")).alias("n_review"))
    dup = dedup.groups(i, distance).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))
    issues = labels.suspected_errors(i, k).agg(F.count(F.lit(1)).alias("n_issues"))
    return gates.health(n, dup, issues, coverage.coverage_gaps(i).agg(F.count_if("under_represented").alias("n_under")))


def _report(w: Workspace, a) -> DataFrame:
    one = graph.cut(_health(w, a.k, a.distance or 0.05))
    export.write_health(w.path("report"), one.first().asDict(), datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S"))
    return one


def _weakness(w: Workspace, a) -> DataFrame:
    gt, pred, m = w.evaluation(a.path, a.iou)
    at = m.where(F.col("thr") == a.iou)
    ap = graph.cut(evaluation.average_precision(at, gt))
    fps = graph.cut(evaluation.false_positives(gt, pred, at))
    parts = {"weakest_classes": evaluation.weakest(ap, evaluation.false_negatives(gt, pred, at), evaluation.confusion(gt, pred, at)), "confident_false_positives": evaluation.rank_false_positives(fps)}
    export.weakness_report(w.path("weakness"), parts)
    one = ap.agg(F.round(F.avg("ap"), 4).alias("map"), F.min("ap").alias("worst_ap")).join(F.broadcast(fps.agg(F.count_if((F.col("type") == "background") & (F.col("conf") >= 0.8)).alias("n_confident_wrong"))))
    out = graph.cut(gates.weakness_health(one))
    w.log("weakness_report", decision=out.first().health, extra={"health": out.first().health})
    return out


def _verdict(w: Workspace, batch: str, eval_path: str | None) -> DataFrame:
    mine = w.boxes.where(F.array_contains("tags", f"batch:{batch}"))
    n_block = boxes.audit(mine).agg(F.count_if(F.col("issue") == "degenerate").alias("n_block"))
    n_clean = labels.suspected_errors(w.items(f"batch:{batch}")).agg(F.count(F.lit(1)).alias("n_clean"))
    return gates.batch_verdict(n_block.join(F.broadcast(n_clean)).withColumn("eval_available", F.lit(bool(eval_path and os.path.exists(eval_path)))).withColumn("batch", F.lit(batch)))


def _batch_gate(w: Workspace, a) -> DataFrame:
    out = graph.cut(_verdict(w, a.batch, a.path))
    w.log("batch_gate", batch_id=a.batch, decision=out.first().verdict)
    return out


def _admit(admit: bool):
    def run(w: Workspace, a) -> DataFrame:
        verdict = _verdict(w, a.batch, a.path).first().verdict if admit else "PASS"
        events, record = review.admit_batch(w.samples, a.batch, verdict, a.force, admit)
        return w.tag(events, **record)

    return run


def _by_role(w: Workspace) -> DataFrame:
    """Items whose split is golden or train, by the tags of their sample."""
    role = w.samples.select("hash", F.when(F.array_contains("tags", "golden"), "golden").when(F.array_contains("tags", "train"), "train").otherwise("").alias("split"))
    return w.items().drop("split").join(role, "hash")


def _gate(w: Workspace, a) -> DataFrame:
    guard = drift.guard(w.items("anchor"), w.items("golden"), w.items("review,pass"), k=a.k)
    leaks = dedup.leakage(_by_role(w), a.distance or 0.05)
    backends = w.samples.select(C.namespace(F.col("tags"), "backend", last=False).alias("backend")).where("backend <> ''")
    extra = []
    if a.path and os.path.exists(w.path("eval_baseline")):
        gt, _, m = w.evaluation(a.path, a.iou)
        ap = graph.cut(evaluation.average_precision(m.where(F.col("thr") == a.iou), gt))
        found = evaluation.check_baseline(ap.select("label", "ap"), ap.select("label", F.col("n_gt").alias("n")), w.spark.read.parquet(w.path("eval_baseline")), evaluation.eval_set_hash(gt).first().hash)
        extra = [f"{r.reason}:{r.label or 'all'}" for r in found.where("kind = 'blocking'").collect()]
    under = coverage.coverage_gaps(w.items("golden"), a.target).where("under_represented")
    one = gates.pre_train(gates.checks(w.samples, under, leaks, backends, guard, ledger.verify_chain(w.ledger), extra))
    return one.select("verdict", "reasons", "under_represented")


def _baseline(w: Workspace, a) -> DataFrame:
    gt, _, m = w.evaluation(a.path, a.iou)
    out = evaluation.freeze_baseline(evaluation.average_precision(m.where(F.col("thr") == a.iou), gt), evaluation.eval_set_hash(gt), files.json_argument(a.map) if a.map else None)
    out = graph.cut(out)
    out.write.mode("overwrite").parquet(w.path("eval_baseline"))
    w.log("set_eval_baseline", decision=str(out.first().map))
    return out


def _mine(w: Workspace, a) -> DataFrame:
    gt, pred, m = w.evaluation(a.path, a.iou)
    at, box = m.where(F.col("thr") == a.iou), ["cx", "cy", "w", "h"]
    fn = evaluation.false_negatives(gt, pred, at).select("image_id", "gt_id").join(gt, ["image_id", "gt_id"]).select(F.lit("fn").alias("kind"), F.col("gt_id").alias("error_id"), F.col("image_id").alias("hash"), "label", *box)
    fp = evaluation.false_positives(gt, pred, at).select("image_id", "pred_id").join(pred, ["image_id", "pred_id"]).select(F.lit("fp").alias("kind"), F.col("pred_id").alias("error_id"), F.col("image_id").alias("hash"), "label", *box)
    dets = w.samples.select("hash", F.posexplode("dets").alias("pos", "d")).select("hash", "pos", "d.embedding", *[f"d.{c}" for c in box])
    pick = files.resolve_tag(w.samples, a.tag) if a.tag else ""
    rest = w.samples.where(C.tagged(F.col("tags"), [pick] if pick else [], ["golden", "anchor", "eval", "rejected"])).select("hash", F.posexplode("dets").alias("pos", "d")).select("hash", "pos", "d.label", "d.confidence", "d.embedding")
    return coverage.error_mine_boxes(vectors.image_items(rest), fn.unionByName(fp), dets, a.top, for_class=a.other or None)


def _bank_audit(w: Workspace, a) -> DataFrame:
    names = {"golden": "defect_like", "rejected": "reflection_like", **({a.tag: "normal_like"} if a.tag else {})}
    banks = None
    for tag in names:
        one = w.items(tag).where("embedding is not null").select("id", F.lit(tag).alias("bank"), "embedding")
        banks = one if banks is None else banks.unionByName(one)
    if banks.where("bank = 'golden'").isEmpty():
        raise ValueError("no golden sample to compare with")
    rest = w.samples.where(C.tagged(F.col("tags"), [], ["golden", "anchor", "eval", "rejected"])).select("hash", F.posexplode("dets").alias("pos", "d")).select("hash", "pos", "d.label", "d.confidence", "d.embedding", "d.cx", "d.cy", "d.w", "d.h")
    found, tags = bank.audit_proposals(rest, graph.cut(banks), names, a.k)
    found = graph.cut(found)
    w.tag(tags.select("hash", "tag", F.lit("add").alias("op"), F.lit(0).cast("long").alias("seq")), event="bank_audit", decision=str(found.count()), extra={"bank_fingerprint": bank.fingerprint(banks, "default").first().hash})
    return found


def _hit_rate(w: Workspace, a) -> DataFrame:
    emitted = w.ledger.where("event = 'queue_emit'").select(F.get_json_object("extra", "$.queue").alias("queue"), F.get_json_object("extra", "$.predict").alias("predict"), "seq", F.explode(F.from_json(F.get_json_object("extra", "$.ids"), "array<string>")).alias("id"))
    done = review.normalise(w.ledger.where("event = 'review'").select(F.col("image_hash").alias("id"), "decision", "seq"))
    return ledger.hit_rate(emitted, done.select("id", "outcome", "seq"))


def _ap_trend(w: Workspace, a) -> DataFrame:
    aps = F.from_json(F.get_json_object("extra", "$.per_class_ap"), "map<string, double>")
    points = w.ledger.where("event = 'eval_ingest'").select("seq", F.explode(aps).alias("label", "ap"))
    return ledger.eval_trend(points)


def _eval_ingest(w: Workspace, a) -> DataFrame:
    gt, _, m = w.evaluation(a.path, a.iou)
    ap = graph.cut(evaluation.average_precision(m, gt))
    at = {r.label: r.ap for r in ap.where(F.col("thr") == a.iou).collect()}
    w.log("eval_ingest", decision=str(len(at)), extra={"per_class_ap": at, "mAP": round(sum(at.values()) / max(1, len(at)), 4), "eval_set_hash": evaluation.eval_set_hash(gt).first().hash})
    return ap


def _route_again(w: Workspace, a) -> DataFrame:
    out = _routed(w, a)
    files.rotate(out, w.folder)
    return w.spark.read.parquet(w.path("routing"))


def _routing_diff(w: Workspace, a) -> DataFrame:
    return routing.routing_diff(w.spark.read.parquet(w.path("routing_prev")), w.spark.read.parquet(w.path("routing")))


def _reviewers(w: Workspace, a) -> DataFrame:
    d = w.ledger.where("event = 'review'").select("reviewer_id", F.col("image_hash").alias("id"), "decision")
    dets = w.samples.select("hash", F.posexplode("dets").alias("pos", "d")).select("hash", "pos", "d.label", "d.confidence", "d.embedding")
    return ledger.reviewer_consistency(d, vectors.image_items(dets))


def _tightness(w: Workspace, a) -> DataFrame:
    masks = w.spark.read.schema("id string, cx double, cy double, w double, h double").json(a.path)
    return boxes.tightness(w.boxes, masks, limit=a.top)


def _embed(w: Workspace, a) -> DataFrame:
    out = files.pixel_embedding(files.scan_images(w.spark, a.folder, content=True))
    out.write.mode("overwrite").parquet(w.path("embeddings"))
    return w.spark.read.parquet(w.path("embeddings")).select("src_path", "image_hash", F.size("embedding").alias("width"))


def _ledger_verb(f: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda w, a: f(w.ledger)


VERBS: dict[str, Callable[[Workspace, argparse.Namespace], DataFrame]] = {
    "ingest": lambda w, a: files.ingest(files.scan_images(w.spark, a.folder), files.read_manifest(w.spark, w.path("manifest")), a.batch)[0],
    "infer": lambda w, a: files.synthetic_detections(files.read_manifest(w.spark, w.path("manifest"))),
    "calibrate": _calibrate,
    "route": _route_again,
    "guard": lambda w, a: drift.guard(w.items("anchor"), w.items("golden"), w.items("review,pass"), k=a.k),
    "audit-labels": lambda w, a: labels.suspected_errors(w.items("golden"), a.k).orderBy(F.desc("disagreement"), "id"),
    "near-dup-labels": lambda w, a: dedup.label_conflicts(w.items(), a.distance or 0.03),
    "dedup": lambda w, a: dedup.groups(w.items(), a.distance or 0.05),
    "coverage": lambda w, a: coverage.coverage_gaps(w.items("golden"), a.target),
    "value": lambda w, a: coverage.coverage_delta(w.items(a.tag), w.items("golden")),
    "active-learn": lambda w, a: coverage.active_learning(w.items("", "golden"), w.items("golden"), a.top),
    "drift": lambda w, a: drift.cross_period(w.items(a.tag), w.items(a.other)),
    "drift-type": lambda w, a: drift.drift_type(w.items(a.tag), w.items(a.other)),
    "compare": lambda w, a: dedup.compare(w.items(a.tag), w.items(a.other), a.k, a.distance or 0.05),
    "review-queue": lambda w, a: coverage.review_queue(w.items("", "golden"), w.items("golden"), a.k, limit=a.top),
    "status": lambda w, a: gates.status(w.samples.select("hash", "tags", F.size("dets").alias("n_dets"), F.exists("dets", lambda d: d["embedding"].isNotNull()).alias("has_embedding"))),
    "audit": lambda w, a: ledger.query(w.ledger, a.event, a.reviewer, a.since, a.until).drop("raw"),
    "history": lambda w, a: ledger.history(w.ledger, a.id).drop("raw"),
    "verify-chain": lambda w, a: ledger.verify_chain(w.ledger),
    "fp-rate": _ledger_verb(ledger.fp_rate),
    "reasons": lambda w, a: ledger.reasons_breakdown(w.ledger.where("event = 'route'")),
    "throughput": _ledger_verb(ledger.throughput),
    "review-rate": _ledger_verb(ledger.review_rate),
    "capacity": lambda w, a: ledger.capacity(w.spark.createDataFrame([(a.volume, a.rate, a.per_hour, a.hours)], "volume long, flag_rate double, per_hour double, hours double")),
    "spc": lambda w, a: monitor.spc(monitor.series(ledger.review_rate(w.ledger), "batch_id", "review_rate")),
    "trend": lambda w, a: drift.quality_trend(w.items()),
    "batch-trend": _ledger_verb(ledger.batch_trend),
    "batch-ledger": lambda w, a: ledger.batch_trend(w.ledger, compat=False),
    "geometry": lambda w, a: drift.geometry_drift(w.boxes.where(C.tagged(F.col("tags"), [a.tag])), w.boxes.where(C.tagged(F.col("tags"), [a.other]))),
    "box-qa": lambda w, a: boxes.audit(w.boxes),
    "parity": lambda w, a: drift.parity(w.samples.select(C.namespace(F.col("tags"), a.tag, last=False).alias("grp"), F.array_max(F.transform("dets", lambda d: d["confidence"])).alias("value")).where("grp <> ''")),
    "calibrate-confidence": lambda w, a: monitor.fit_temperature(files.read_calibration(w.spark, a.path)).join(F.broadcast(monitor.calibration_error(files.read_calibration(w.spark, a.path)))),
    "label-noise": lambda w, a: labels.noise_rates(labels.confident_joint(labels.with_predictions(w.items("golden"), a.k))),
    "new-classes": lambda w, a: dedup.new_classes(w.items("", "golden"), w.items("golden")),
    "leakage": lambda w, a: dedup.leakage(w.items(), a.distance or 0.05),
    "harmful": lambda w, a: coverage.harmful(w.items(), labels.suspected_errors(w.items(), a.k), dedup.group_ids(w.items()), top=a.top),
    "explain": lambda w, a: routing.explain(routing.score_detections(w.items("", "golden"), w.items("golden"), a.k), w.thresholds),
    "hardneg": lambda w, a: coverage.overturns(routing.score_detections(w.items("", "golden"), w.items("golden"), a.k).join(w.thresholds.drop("n_support"), "label"), a.top),
    "eval-ingest": _eval_ingest,
    "consistency": lambda w, a: bank.attribute(bank.pair_stats(w.items("golden"))),
    "adapt-embedding": lambda w, a: bank.projection_gate(bank.adaptation(w.items("golden"))),
    "worklists": lambda w, a: review.worklists(w.samples),
    "set-threshold": lambda w, a: routing.set_threshold(w.thresholds, a.tag, a.conf, a.distance),
    "export": lambda w, a: export.label_files(export.exportable(w.samples).select("hash", "src_path"), export.yolo_lines(w.boxes, labels.align_class_maps(*[w.boxes.select("label").distinct().select(F.lit(0).alias("cid"), F.col("label").alias("name"))] * 2).select(F.col("name").alias("label"), F.col("new_id").cast("int").alias("idx"))), a.val),
    "resolve": _resolve,
    "sync-reviews": _sync,
    "dismiss": _dismiss("remove"),
    "restore-dismissed": _dismiss("add"),
    "snapshot": _snapshot,
    "restore": _restore,
    "merge": _merge,
    "merge-preview": _preview,
    "relabel": _relabel,
    "report": _report,
    "weakness-report": _weakness,
    "batch-gate": _batch_gate,
    "batch-admit": _admit(True),
    "batch-unadmit": _admit(False),
    "gate": _gate,
    "verify": lambda w, a: export.verify(files.read_hashes(w.spark, a.path), files.hash_files(w.spark, a.folder)),
    "error-mine": _mine,
    "bank-audit": _bank_audit,
    "reviewer-audit": _reviewers,
    "queue-hit-rate": _hit_rate,
    "ap-trend": _ap_trend,
    "health-trend": lambda w, a: ledger.health_series(w.ledger),
    "routing-diff": _routing_diff,
    "cost-gate": lambda w, a: monitor.cost_gate(ledger.fp_rate(w.ledger).select(F.lit(a.rate).alias("miss_rate"), F.coalesce("fp_rate", F.lit(0.0)).alias("fa_rate")), a.miss_cost, a.fa_cost, a.budget),
    "set-eval-baseline": _baseline,
    "box-tightness": _tightness,
    "embed": _embed,
    "run": lambda w, a: runs.curate(w.samples, k=a.k).results["gate"],
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="curaspark", description=__doc__)
    p.add_argument("workspace")
    p.add_argument("verb", choices=sorted(VERBS))
    for name in ("folder", "batch", "tag", "other", "event", "reviewer", "since", "until", "id", "path", "decision", "map"):
        p.add_argument(f"--{name}", default="" if name in ("tag", "other") else None)
    for name, kind, value in (("k", int, 10), ("top", int, 50), ("distance", float, None), ("target", float, None), ("iou", float, 0.5), ("conf", float, None), ("val", float, 0.0), ("volume", int, 0), ("rate", float, 0.0), ("per-hour", float, 0.0), ("hours", float, 8.0), ("miss-cost", float, 1.0), ("fa-cost", float, 1.0), ("budget", float, 0.0)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("curaspark").getOrCreate()
    out = VERBS[a.verb](Workspace(spark, a.workspace), a)
    rows = out.limit(a.top).collect()
    print("\t".join(out.columns))
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r))
    bad = any(getattr(r, "verdict", None) in ("NO-GO", "BLOCK", "PARTIAL") for r in rows)
    return 2 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
