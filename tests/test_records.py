import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from curaspark.operators import export, gates, labels, ledger, review
from curaspark.sources import files


def test_ledger_chain_tamper_and_truncation(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    ledger.append(spark, path, [{"event": "ingest", "image_hash": f"h{i}", "ts_utc": f"2026-01-0{i + 1}"} for i in range(5)])
    with open(path, "a") as f:
        f.write('{"event": "torn')
    assert ledger.append(spark, path, [{"event": "review", "image_hash": "h1", "decision": "confirmed", "ts_utc": "2026-01-09"}]) == 6
    rec = files.read_ledger(spark, path)
    assert rec.count() == 6
    ok = ledger.verify_chain(rec).collect()
    assert all(r.link_ok and r.hash_ok for r in ok)
    assert not ledger.truncation(rec, 6).first().truncated and ledger.truncation(rec.limit(3), 6).first().truncated
    assert ledger.truncation(rec, None).first().truncated
    lines = open(path).read().split("\n")
    lines[1] = lines[1].replace('"h1"', '"hX"')
    open(path, "w").write("\n".join(lines))
    bad = [r.seq for r in ledger.verify_chain(files.read_ledger(spark, path)).where("not hash_ok or not link_ok").collect()]
    assert bad == [1]
    assert [r.event for r in ledger.query(rec, event="resolve", since="2026-01-05", until="2026-01-09").collect()] == ["review"]


def test_hit_rate_counts_resolutions_after_emission(spark):
    e = spark.createDataFrame([("q", "wrong", 5, "a"), ("q", "wrong", 5, "b"), ("q", "wrong", 9, "a"), ("q", "wrong", 5, "c")], "queue string, predict string, seq long, id string")
    r = spark.createDataFrame([("a", "confirmed", 1), ("a", "rejected", 7), ("b", "confirmed", 8)], "id string, outcome string, seq long")
    x = ledger.hit_rate(e, r).first()
    assert (x.emitted, x.resolved, x.hits, x.precision, x.coverage, x.insufficient, list(x.trend)) == (4, 2, 1, 0.5, 0.5, True, [0.5])


def test_throughput_and_reviewers(spark):
    rows = [(1, "2026-01-01 00:00:00", "route", "x", "review", "r"), (2, "2026-01-01 02:00:00", "review", "x", "confirmed", "r"), (3, "2026-01-01 00:00:00", "route", "y", "review", "r")]
    l = spark.createDataFrame(rows, "seq long, ts string, event string, image_hash string, decision string, reviewer_id string").withColumn("ts", F.to_timestamp("ts"))
    t = ledger.throughput(l).first()
    assert (t.resolved, t.open, t.median_hours) == (1, 1, 2.0)
    items = spark.createDataFrame([("x1", "a", [1.0, 0.0]), ("x2", "a", [1.0, 0.0]), ("y", "a", [0.0, 1.0])], "id string, label string, embedding array<double>")
    d = spark.createDataFrame([("u", 1, "x1", "pass"), ("u", 2, "x2", "reject"), ("v", 3, "x1", "pass"), ("v", 4, "x1", "pass"), ("v", 5, "y", "reject")], "reviewer_id string, seq long, id string, decision string")
    got = {r.reviewer_id: (r.similar_pairs, r.conflicts, r.intra_consistency) for r in ledger.reviewer_consistency(d, items).collect()}
    assert got == {"u": (1, 1, 0.0), "v": (1, 0, 1.0)}


def test_ingest_skips_known_and_repeated(spark, tmp_path):
    folder = tmp_path / "img" / "cat"
    folder.mkdir(parents=True)
    for name, body in (("a.png", b"1"), ("b.jpg", b"1"), ("c.PNG", b"2"), ("d.txt", b"3"), ("e.bmp", b"4")):
        (folder / name).write_bytes(body)
    images = files.scan_images(spark, str(tmp_path / "img"))
    assert images.count() == 4
    known = spark.createDataFrame([(hashlib.sha256(b"4").hexdigest(), "", "", "", "", [])], files.MANIFEST)
    new, skipped = files.ingest(images, known, "b1", tags=["review"])
    assert sorted(os.path.basename(r.src_path) for r in new.collect()) == ["a.png", "c.PNG"] and skipped.count() == 2
    assert new.first().tags == ["review", "batch:b1"]
    with pytest.raises(ValueError):
        files.ingest(images, known, "b1", tags=["golden", "eval"])
    path = str(tmp_path / "manifest")
    files.append_manifest(new, path)
    files.append_manifest(new, path, files.read_manifest(spark, path))
    assert files.read_manifest(spark, path).count() == 2
    d = files.synthetic_detections(files.read_manifest(spark, path)).first()
    assert d.label == "cat" and 0.4 <= d.confidence <= 1.0


def test_eval_sources(spark, tmp_path):
    one = {files.DISK_KEY: "h", "gt": [{"label": "a", "bbox": [0.5, 0.5, 0.1, 0.1]}], "pred": [{"label": "a", "bbox": [0.5, 0.5, 0.1, 0.1], "conf": 0.9}]}
    for name, body in (("lines", json.dumps(one) + "\n" + json.dumps({**one, files.DISK_KEY: "g", "pred": []})), ("array", json.dumps([one, {**one, files.DISK_KEY: "g", "pred": None}], indent=1))):
        (tmp_path / name).write_text(body)
        gt, pred = files.eval_tables(files.read_eval(spark, str(tmp_path / name)))
        assert (gt.count(), pred.count()) == (2, 1)


def test_thresholds_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", 0.5, 0.2, 10), ("b", 0.0, float("inf"), 0)], "label string, conf_thr double, dist_thr double, n_support long")
    path = str(tmp_path / "t.json")
    files.save_thresholds(t, path, {"calibrated_at": "now"})
    assert sorted(map(tuple, files.load_thresholds(spark, path).collect())) == sorted(map(tuple, t.collect()))
    assert files.json_argument('{"a": 1}') == {"a": 1}


def test_voc(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<annotation><filename>f.jpg</filename><size><width>100</width><height>50</height></size><object><name>cat</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>20</ymax></bndbox></object></annotation>")
    r = files.voc_boxes(spark, str(tmp_path / "x.xml")).first()
    assert (r.label, r.cx, r.cy, r.w, r.h) == ("cat", 0.2, 0.3, 0.2, 0.2)


def test_tags_fold_and_resolutions(spark):
    s = spark.createDataFrame([("a", ["review"]), ("b", []), ("c", None)], "hash string, tags array<string>")
    ev = review.resolve(s, spark.createDataFrame([("a", "confirm"), ("b", "Rejected"), ("c", "scratch")], "hash string, decision string"))
    tags = {r.hash: list(r.tags) for r in review.fold_tags(s, ev).collect()}
    assert tags == {"a": ["golden", "review"], "b": ["rejected"], "c": ["golden"]}
    with pytest.raises(ValueError):
        review.resolve(s, spark.createDataFrame([("zz", "confirm")], "hash string, decision string"))
    gone = review.dismiss(s.where("hash = 'a'").select("hash"), first_seq=10**12)
    assert list(review.fold_tags(s, ev.unionByName(gone)).where("hash = 'a'").first().tags) == ["golden"]


def test_relabel_and_rollback(spark):
    i = spark.createDataFrame([("1", "car"), ("2", "truck"), ("3", "van")], "id string, label string")
    out, log = labels.relabel(i, spark.createDataFrame([("car", "vehicle"), ("truck", "vehicle")], "old string, new string"))
    assert sorted(r.label for r in out.collect()) == ["van", "vehicle", "vehicle"]
    back = labels.rollback(out, log.withColumn("line", F.monotonically_increasing_id()))
    assert sorted(map(tuple, back.select("id", "label").collect())) == [("1", "car"), ("2", "truck"), ("3", "van")]


def test_export_and_verify(spark, tmp_path):
    s = spark.createDataFrame([("h1", "/x/a.jpg"), ("h2", "/y/a.png"), ("h3", "/z/b.jpg")], "hash string, src_path string")
    dets = spark.createDataFrame([("h1", "/x/a.jpg", 0, "cat", 0.5, 0.5, 1.0, 1.0), ("h1", "/x/a.jpg", 1, "dog", 0.25, 0.5, 0.5, 1.0), ("h2", "/y/a.png", 0, "odd", 0.5, 0.5, 1.0, 1.0)], "hash string, src_path string, pos int, label string, cx double, cy double, w double, h double")
    names = spark.createDataFrame([("cat", 0), ("dog", 1)], "label string, idx int")
    f = export.label_files(s, export.yolo_lines(dets, names), 0.4)
    got = {r.hash: (r.name, r.split, r.body) for r in f.collect()}
    assert got["h1"] == ("a", "val", "0 0.500000 0.500000 1.000000 1.000000\n1 0.250000 0.500000 0.500000 1.000000")
    assert got["h2"][:2] == ("a_1", "train") and got["h3"] == ("b", "train", "")
    assert export.write_label_files(f, str(tmp_path)) == 3
    assert (tmp_path / "labels" / "val" / "a.txt").read_text().startswith("0 0.5")
    assert export.unknown_classes(dets, names).first().label == "odd"
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    h = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {r.path: r.problem for r in export.verify(m, h).collect()} == {"b": "mismatched", "c": "missing", "d": "unexpected"}
    assert "nc: 2" in export.data_yaml("/d", ["cat", "dog"], True)
    out = export.weakness_report(str(tmp_path / "r"), {"Files <1>": h})
    assert "&lt;1&gt;" in open(out[1]).read() and "| a | 1 |" in open(out[0]).read()


def test_gates(spark):
    one = spark.createDataFrame([(0, 1, False, 2, 0, ["x"], True, False, [])], "n_golden long, eval_golden_overlap long, backend_mixed boolean, n_review_open long, golden_train_overlap long, under_represented array<string>, drift_triggered boolean, chain_intact boolean, extra array<string>")
    r = gates.pre_train(one).first()
    assert r.verdict == "NO-GO" and list(r.reasons) == ["no_golden", "eval_golden_overlap", "review_open", "under_represented", "drift", "chain_broken"]
    c = spark.createDataFrame([("a", 1, 1, False), ("b", 0, 1, False), ("c", 0, 1, True), ("d", 0, 0, True)], "batch string, n_block long, n_clean long, eval_available boolean")
    assert [r.verdict for r in gates.batch_verdict(c).orderBy("batch").collect()] == ["BLOCK", "PARTIAL", "CLEAN", "PASS"]


def test_streaming_ingest_enters_once(spark, tmp_path):
    from curaspark.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"1")
    files.append_manifest(spark.createDataFrame([("k", "", "", "", "", [])], files.MANIFEST), str(tmp_path / "m"))
    for _ in range(2):
        ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "m"), str(tmp_path / "cp"), "b").awaitTermination(60)
        (tmp_path / "in" / "b.png").write_bytes(b"1")
    assert files.read_manifest(spark, str(tmp_path / "m")).count() == 2


# the registered queries against SQL ------------------------------------------------

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    return v if v is None or isinstance(v, str | bool) else round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(([plain(r[cols.index(c)]) for c in order] for r in cur.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr) == want


def test_one_stop_run(spark):
    from curaspark.plans import run

    det = "array<struct<label: string, confidence: double, embedding: array<double>>>"
    rows = [(f"g{c}{i}", ["golden"], [(c, 0.9, [1.0, 0.05 * i] if c == "a" else [0.05 * i, 1.0])]) for c in "ab" for i in range(12)]
    rows += [("new_ok", ["batch:w1"], [("a", 0.95, [1.0, 0.3])]), ("new_low", [], [("a", 0.1, [1.0, 0.3])]), ("new_far", [], [("a", 0.95, [0.0, 1.0])]), ("none", [], [])]
    r = run.curate(spark.createDataFrame(rows, f"hash string, tags array<string>, dets {det}"), k=5)
    assert r.failed is None, r.error
    assert {x.hash: x.decision for x in r.results["route"].collect()} == {"new_ok": "pass", "new_low": "review", "new_far": "review", "none": "review"}
    assert r.results["gate"].first().verdict == "NO-GO"
    bad = run.steps([("a", lambda _: 1), ("b", lambda _: 1 / 0), ("c", lambda _: 2)])
    assert bad.done == ["a"] and bad.failed == "b"


def test_clusters_and_encoders(spark):
    import numpy as np

    from curaspark.operators import clusters
    from curaspark.sources import encoders

    df = spark.createDataFrame([(i, "a" if i < 10 else "b", [float(i >= 10) * 9, 0.1 * i]) for i in range(20)], "id long, label string, embedding array<double>")
    assert [(r.n, r.purity) for r in clusters.purity(clusters.clusters(df, 2)).collect()] == [(10, 1.0), (10, 1.0)]
    assert encoders.fingerprint("m", 3) != encoders.fingerprint("m", 3, np.ones(3))
    got = encoders.embed(df.select("id"), lambda v: np.array([[x, 2 * x] for x in v]), "id").orderBy("id").collect()
    assert got[3].embedding == [3.0, 6.0]


def test_command_line(spark, tmp_path, capsys):
    from curaspark import cli

    det = "array<struct<label: string, confidence: double, cx: double, cy: double, w: double, h: double, embedding: array<double>>>"
    rows = [(f"g{c}{i}", f"/d/{c}{i}.png", ["golden", "fab:F1"], [(c, 0.9, 0.5, 0.5, 0.2, 0.2, [1.0, 0.05 * i] if c == "a" else [0.05 * i, 1.0])]) for c in "ab" for i in range(12)]
    rows += [("new", "/d/new.png", ["batch:w1"], [("a", 0.3, 0.5, 0.5, 0.2, 0.2, [1.0, 0.3])])]
    spark.createDataFrame(rows, f"hash string, src_path string, tags array<string>, dets {det}").write.parquet(str(tmp_path / "samples"))
    ledger.append(spark, str(tmp_path / "ledger.jsonl"), [{"event": "route", "image_hash": "new", "decision": "review", "batch_id": "w1", "ts_utc": "2026-01-01T00:00:00"}, {"event": "review", "image_hash": "new", "decision": "confirmed", "ts_utc": "2026-01-01T03:00:00"}])
    assert cli.main([str(tmp_path), "calibrate", "--k", "5"]) == 0
    assert cli.main([str(tmp_path), "route", "--k", "5"]) == 0
    assert "new" in capsys.readouterr().out
    for verb in ("status", "audit-labels", "dedup", "coverage", "review-queue", "box-qa", "throughput", "reasons", "fp-rate", "spc", "parity", "export", "explain", "verify-chain"):
        assert cli.main([str(tmp_path), verb, "--k", "5", "--tag", "fab"]) == 0, verb
    assert cli.main([str(tmp_path), "run", "--k", "5"]) == 2


def test_admission_rotation_and_hashes(spark, tmp_path):
    s = spark.createDataFrame([("a", ["batch:w1"]), ("b", ["batch:w2", "admitted"])], "hash string, tags array<string>")
    ev, rec = review.admit_batch(s, "w1", "PASS")
    assert [r.hash for r in ev.collect()] == ["a"] and rec["decision"] == "OK" and rec["extra"]["pool_before"] != rec["extra"]["pool_after"]
    ev, rec = review.admit_batch(s, "w1", "BLOCK")
    assert ev.count() == 0 and rec["decision"] == "REFUSED" and rec["extra"]["pool_before"] == rec["extra"]["pool_after"]
    assert review.admit_batch(s, "w2", "BLOCK", admit=False)[1]["event"] == "batch_unadmit"
    for k in range(3):
        files.rotate(spark.createDataFrame([(k,)], "k int"), str(tmp_path))
    assert (spark.read.parquet(str(tmp_path / "routing")).first().k, spark.read.parquet(str(tmp_path / "routing_prev")).first().k) == (2, 1)
    (tmp_path / "f" / "g").mkdir(parents=True)
    (tmp_path / "f" / "g" / "x.txt").write_bytes(b"1")
    assert [tuple(r) for r in files.hash_files(spark, str(tmp_path / "f")).collect()] == [("g/x.txt", hashlib.sha256(b"1").hexdigest())]
    files.append_lines(spark.createDataFrame([("a", "car", "van")], "id string, old string, new string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_write_back_verbs(spark, tmp_path, capsys):
    from curaspark import cli

    det = "array<struct<label: string, confidence: double, cx: double, cy: double, w: double, h: double, embedding: array<double>>>"
    vec = lambda c, i: [1.0, 0.05 * i, 0.1] if c == "a" else [0.05 * i, 1.0, 0.1]
    rows = [(f"g{c}{i}", f"/d/{c}{i}.png", ["golden"], [(c, 0.9, 0.5, 0.5, 0.2, 0.2, vec(c, i))]) for c in "ab" for i in range(8)]
    rows += [(f"n{i}", f"/d/n{i}.png", ["batch:w1", "review"], [("a", 0.1 + 0.05 * i, 0.5, 0.5, 0.2, 0.2, vec("a", 3 * i))]) for i in range(4)]
    rows += [("r0", "/d/r0.png", ["rejected"], [("a", 0.9, 0.5, 0.5, 0.2, 0.2, [0.1, 0.1, 1.0])]), ("r1", "/d/r1.png", ["rejected"], [("a", 0.9, 0.5, 0.5, 0.2, 0.2, [0.1, 0.2, 1.0])])]
    spark.createDataFrame(rows, f"hash string, src_path string, tags array<string>, dets {det}").write.parquet(str(tmp_path / "samples"))
    ledger.append(spark, str(tmp_path / "ledger.jsonl"), [{"event": "route", "image_hash": f"n{i}", "decision": "review", "batch_id": "w1", "ts_utc": "2026-01-01T00:00:00"} for i in range(4)])
    ledger.append(spark, str(tmp_path / "ledger.jsonl"), [{"event": "queue_emit", "ts_utc": "2026-01-01T01:00:00", "extra": json.dumps({"queue": "q", "predict": "wrong", "ids": ["n0", "n1"]})}])
    image = lambda h, truth, pred: {files.DISK_KEY: h, "gt": [{"label": "a", "bbox": truth}], "pred": [{"label": "a", "bbox": pred, "conf": 0.9}]}
    (tmp_path / "eval.jsonl").write_text("\n".join(json.dumps(x) for x in [image("ga0", [0.5, 0.5, 0.2, 0.2], [0.5, 0.5, 0.2, 0.2]), image("ga1", [0.5, 0.5, 0.2, 0.2], [0.9, 0.9, 0.1, 0.1])]))
    (tmp_path / "pulled").write_text('{"hash": "n1", "decision": "false_alarm"}\n{"hash": "n2", "decision": "b"}\n')
    (tmp_path / "masks").write_text('{"id": "n3:0", "cx": 0.5, "cy": 0.5, "w": 0.05, "h": 0.05}\n')

    def run(*args):
        capsys.readouterr()
        code = cli.main([str(tmp_path), *args])
        return code, [x.split("\t") for x in capsys.readouterr().out.strip().split("\n")]

    def tags(h):
        return set(cli.Workspace(spark, str(tmp_path)).samples.where(f"hash = '{h}'").first().tags)

    ev = str(tmp_path / "eval.jsonl")
    run("snapshot", "--id", "s1")
    run("resolve", "--id", "n0", "--decision", "confirm", "--reviewer", "me")
    assert "golden" in tags("n0")
    run("sync-reviews", "--path", str(tmp_path / "pulled"))
    assert "rejected" in tags("n1") and "golden" in tags("n2")
    with pytest.raises(ValueError):
        run("resolve", "--id", "n0,nobody")
    run("dismiss", "--id", "n3")
    assert "review" not in tags("n3")
    run("restore-dismissed", "--id", "n3")
    assert "review" in tags("n3")
    assert run("queue-hit-rate")[1][1][:5] == ["q", "wrong", "2", "1", "0"]
    assert sorted(r[0] for r in run("restore", "--id", "s1")[1][1:]) == ["n0", "n2"]
    assert "golden" not in tags("n0")
    assert run("merge", "--tag", "golden", "--other", "rejected", "--map", '{"b": "c"}')[1][1:] == [["a", "0", "11", "common", "False"], ["c", "1", "8", "only_a", "True"]]
    assert run("merge-preview", "--tag", "golden", "--other", "rejected")[1][1:] == [["a", "11"], ["b", "8"]]
    assert run("relabel", "--tag", "golden", "--map", '{"b": "c"}')[1][1:] == [["b", "c", "8"]]
    assert spark.read.json(str(tmp_path / "relabels")).count() == 8
    run("eval-ingest", "--path", ev)
    run("set-eval-baseline", "--path", ev, "--map", '{"a": 0.01}')
    code, gate = run("gate", "--path", ev, "--k", "3")
    assert code == 2 and "review_open" in gate[1][1]
    run("eval-ingest", "--path", ev)
    assert run("ap-trend")[1][1][:2] == ["a", "2"]
    assert run("weakness-report", "--path", ev)[1][1][-1] in ("RED", "AMBER", "GREEN")
    assert (tmp_path / "weakness" / "report.md").exists() and (tmp_path / "weakness" / "weakest_classes").is_dir()
    assert run("health-trend")[1][1][1] in ("RED", "AMBER", "GREEN")
    run("report", "--k", "3")
    assert len(list((tmp_path / "report" / "history").iterdir())) == 1
    assert run("batch-gate", "--batch", "w1")[1][1][-1] == "PARTIAL"
    run("batch-admit", "--batch", "w1")
    assert "admitted" in tags("n3")
    run("batch-unadmit", "--batch", "w1")
    assert "admitted" not in tags("n3")
    mined = run("error-mine", "--path", ev)[1][1:]
    assert {r[0] for r in mined} <= {f"n{i}" for i in range(4)} and mined
    audit = run("bank-audit", "--k", "3")[1]
    assert len(audit) > 1 and "proposal" in tags("n0")
    run("calibrate", "--k", "3")
    run("route", "--k", "3")
    run("route", "--k", "3")
    assert run("routing-diff")[1][1:] == []
    assert run("cost-gate", "--rate", "0.1", "--miss-cost", "10", "--budget", "5")[0] == 0
    assert run("box-tightness", "--path", str(tmp_path / "masks"))[1][1][0] == "n3:0"
    assert run("reviewer-audit")[0] == 0
    assert all(r.link_ok and r.hash_ok for r in ledger.verify_chain(files.read_ledger(spark, str(tmp_path / "ledger.jsonl"))).collect())


def test_numbered_names_meet_no_other_stem(spark):
    from curaspark.operators import export

    s = spark.createDataFrame([("h1", "/x/a.png"), ("h2", "/y/a.png"), ("h3", "/z/a_1.png")], "hash string, src_path string")
    lines = spark.createDataFrame([("h1", 0, "0 1")], "hash string, pos int, line string")
    names = [r.name for r in export.label_files(s, lines).collect()]
    assert len(set(names)) == 3 and {"a", "a_1"} <= set(names)


def test_ledger_lines_are_numbered_over_blocks(spark, tmp_path):
    path = str(tmp_path / "l.jsonl")
    ledger.append(spark, path, [{"event": "route", "image_hash": f"h{i}", "decision": "pass", "extra": "x" * 300} for i in range(200)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = files.read_ledger(spark, path).orderBy("seq").collect()
        assert [(r.seq, r.image_hash) for r in rows] == [(i, f"h{i}") for i in range(200)]
        assert all(r.link_ok and r.hash_ok for r in ledger.verify_chain(files.read_ledger(spark, path), run=7).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
