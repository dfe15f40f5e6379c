import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.operators import coverage, dedup, drift, graph, labels, routing, vectors

ITEM = "id string, label string, embedding array<double>, confidence double, batch string, split string"


def items(spark, rows):
    return spark.createDataFrame([(r + (1.0, "", ""))[:6] if len(r) == 3 else r for r in rows], ITEM)


def clusters(spark, bad=("a", [0.0, 1.0])):
    rows = [(f"a{i}", "a", [1.0, 0.01 * i]) for i in range(8)] + [(f"b{i}", "b", [0.01 * i, 1.0]) for i in range(8)]
    return items(spark, [*rows, ("bad", *bad)])


def plain_knn(x, k):
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -np.inf)
    return [sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block": 16}])
def test_knn_is_exact(spark, how):
    x = np.random.default_rng(0).normal(size=(90, 6))
    x[5], x[7] = x[6], 0.0
    df = spark.createDataFrame([(i, f"c{i % 3}", v.tolist()) for i, v in enumerate(x)] + [(1000, "c0", None)], "id long, label string, embedding array<double>")
    got = {}
    for r in vectors.knn(df, df, 5, **how).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.nid)
    assert got == dict(enumerate(plain_knn(x, 5)))
    same = vectors.knn(df, df, 3, same_label=True, **how).collect()
    assert all(r.label == r.nlabel for r in same)


def test_knn_of_every_label(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 4))
    x[10], x[11] = x[12], x[12]
    rows = [(i, [None, "a", "b"][i % 3], v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label string, embedding array<double>")
    order = plain_knn(x, 69)
    for how in ({}, {"broadcast_bytes": 0, "block": 16}):
        got = {}
        for r in vectors.knn(df, df, 4, per_label=True, **how).orderBy("id", "nlabel", "rank").collect():
            got.setdefault((r.id, r.nlabel), []).append(r.nid)
        assert got == {(i, c): [j for j in order[i] if rows[j][1] == c][:4] for i in range(70) for c in (None, "a", "b")}


@pytest.mark.parametrize("block,parts", [(16, 5), (16, 6), (2048, 3), (7, 1)])
def test_block_pairs_lose_no_pair(spark, block, parts):
    """Odd and even numbers of blocks, rows in no order."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 6)), 3, axis=0) + rng.normal(0, 0.01, (90, 6))
    df = spark.createDataFrame([(int(i), "a", x[i].tolist()) for i in rng.permutation(90)], "id long, label string, embedding array<double>").repartition(parts)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    got = {(r.a, r.b): r.sim for r in vectors.similar_pairs(df, 0.99, block=block).collect()}
    assert got == {(i, j): pytest.approx(s[i, j]) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.99}
    group = {r.node: r.component for r in graph.components(vectors.links(df, 0.01, block=block)).collect()}
    lab = list(range(90))
    for _ in range(90):
        for i, j in zip(*np.nonzero(1 - u @ u.T < 0.01), strict=True):
            lab[i] = lab[j] = min(lab[i], lab[j])
    assert [group.get(i, i) for i in range(90)] == lab
    assert vectors.similar_pairs(df.limit(0), 0.9).collect() == [] and vectors.links(df.limit(0), 0.9).collect() == []


def test_label_audit_finds_the_planted_error(spark):
    got = labels.suspected_errors(clusters(spark), 5).collect()
    assert [(r.id, r.suggested_label, r.disagreement) for r in got] == [("bad", "b", 1.0)]
    assert labels.suspected_errors(clusters(spark).limit(0)).collect() == []
    assert labels.suspected_errors(clusters(spark).limit(1)).collect() == []


def test_majority_ties_go_to_the_smaller_label(spark):
    near = spark.createDataFrame([("q", "z", "n1", "b", 0.9, 1), ("q", "z", "n2", "a", 0.8, 2)], "id string, label string, nid string, nlabel string, sim double, rank int")
    assert labels.majority(near).first().majority == "a"


def test_confident_learning(spark):
    rows = [(f"a{i}", "a", "a", 0.9) for i in range(20)] + [(f"b{i}", "b", "b", 0.9) for i in range(20)] + [(f"x{i}", "a", "b", 0.97) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, given string, pred string, conf double")
    assert {r.id for r in labels.confident_issues(df).collect()} == {f"x{i}" for i in range(5)}
    rates = labels.noise_rates(labels.confident_joint(df)).collect()
    assert [(r.given, r.pred, r.rate) for r in rates] == [("a", "b", 0.2)]


def test_near_duplicates_and_leakage(spark):
    df = items(spark, [("x1", "a", [1.0, 0.0], 1.0, "", "train"), ("x2", "b", [1.0, 0.0001], 1.0, "", "test"), ("y", "a", [0.0, 1.0], 1.0, "", "train"), ("z", "a", [0.0, 0.0], 1.0, "", "")])
    assert [(r.n, r.ids) for r in dedup.groups(df, 0.01).collect()] == [(2, ["x1", "x2"])]
    assert [r.splits for r in dedup.leakage(df, 0.01).collect()] == [["test", "train"]]
    assert dedup.label_conflicts(df, 0.01).first().n_labels == 2
    assert dedup.groups(df.limit(0)).collect() == []
    lsh = {(r.a, r.b) for r in dedup.lsh_links(df, 0.01).collect()}
    assert lsh <= {("x1", "x2")}


def test_dense_groups_stay_small(spark):
    df = spark.createDataFrame([(i, "a", [1.0, i * 1e-9]) for i in range(300)], "id long, label string, embedding array<double>")
    assert vectors.links(df, 0.05, block=64).count() < 300 * 12
    assert dedup.groups(df).first().n == 300


def test_signature_join_loses_no_link(spark):
    r = np.random.default_rng(0)
    m = np.concatenate([r.normal(size=(200, 8)), np.repeat(r.normal(size=(2, 8)), 40, axis=0), np.zeros((1, 8))])
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(m)] + [(999, "a", None)], "id long, label string, embedding array<double>")
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    for radius, block in ((0.4, 32), (0.02, 16), (0.4, 4096)):
        near = (1 - u @ u.T < radius) & ~np.eye(len(u), dtype=bool)
        pairs = vectors.near_pairs(df, radius, block=block).collect()
        assert sorted((p.a, p.b) for p in pairs) == sorted((i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if i < j)
        edges = vectors.near_links(df, radius, block=block)
        n = {x.a: x.n for x in edges.groupBy("a").sum("n").toDF("a", "n").collect()}
        assert n == {i: int(k) for i, k in enumerate(near.sum(axis=1)) if k}
    assert {(p.a, p.b) for p in dedup.lsh_links(df, 0.4).collect()} == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if i < j}
    reach = np.eye(len(u), dtype=bool) | near
    for _ in range(9):
        reach = reach @ reach
    want = {i: (int(np.argmax(row)), int(k)) for i, (row, k) in enumerate(zip(reach, near.sum(axis=1), strict=True))} | {999: (999, 0)}
    for edges in (0, 1 << 21):  # classes in rounds, or in one task
        assert {x.id: (x.class_id, x.links) for x in dedup.lsh_classes(df, 0.4, one_task=edges).collect()} == want
    assert dedup.lsh_classes(df.limit(0)).collect() == [] and dedup.lsh_classes(df.where("id = 3")).collect() == [(3, 3, 0)]


def test_far_blocks_are_passed_over(spark):
    r = np.random.default_rng(1)
    m = np.concatenate([c + r.normal(0, 0.01, (64, 6)) for c in np.eye(6)])
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(m)], "id long, label string, embedding array<double>")
    assert vectors._near_blocks(df, 0.05, 16, 16, 0).count() < 24 * 25 // 2
    assert dedup.lsh_classes(df).groupBy("class_id").count().count() == 6


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(99, 98)], "a long, b long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 98: 98, 99: 98}
    assert {r.node: r.component for r in graph.components_in_one(e).collect()} == got and graph.components_in_one(e.limit(0)).collect() == []


def test_new_classes(spark):
    ref = items(spark, [("r", "a", [1.0, 0.0, 0.0])])
    q = items(spark, [("near", "a", [0.99, 0.01, 0.0]), ("n1", "a", [0.0, 1.0, 0.0]), ("n2", "a", [0.0, 1.0, 0.01]), ("lone", "a", [0.0, 0.0, 1.0])])
    got = {r.id: (r.cluster, r["size"]) for r in dedup.new_classes(q, ref).collect()}
    assert got == {"n1": ("n1", 2), "n2": ("n1", 2), "lone": ("lone", 1)}


def test_calibrate_and_route(spark):
    g = [(f"a{i}", "a", [1.0, 0.001 * i], 0.9, "", "") for i in range(12)] + [(f"b{i}", "b", [0.001 * i, 1.0], 0.9, "", "") for i in range(12)] + [("lone", "c", [1.0, 1.0], 0.7, "", "")]
    golden = items(spark, g)
    thr = routing.calibrate(golden)
    t = {r.label: r for r in thr.collect()}
    assert t["a"].conf_thr == pytest.approx(0.9) and t["c"].dist_thr == 0.0 and t["c"].n_support == 1
    dets = items(spark, [("ok", "a", [1.0, 0.005], 0.95, "", ""), ("low", "a", [1.0, 0.005], 0.1, "", ""), ("far", "a", [0.0, 1.0], 0.95, "", ""), ("new", "zz", [1.0, 0.0], 0.95, "", ""), ("none", "a", None, 0.95, "", "")])
    r = {x.id: list(x.reasons) for x in routing.route(routing.score_detections(dets, golden), thr).collect()}
    assert r == {"ok": [], "low": ["low_conf"], "far": ["far_from_known"], "new": ["far_from_known", "low_support"], "none": ["far_from_known"]}
    images = spark.createDataFrame([("i1",), ("i2",)], "hash string")
    routed = routing.route(routing.score_detections(dets, golden), thr).withColumn("hash", F.lit("i1"))
    out = {x.hash: (x.decision, list(x.reasons)) for x in routing.route_images(images, routed).collect()}
    assert out == {"i1": ("review", ["far_from_known", "low_conf", "low_support"]), "i2": ("review", ["no_detection"])}


def test_coverage(spark):
    df = clusters(spark)
    gaps = {r.label: (r.n, r.under_represented, r.need) for r in coverage.coverage_gaps(df, 10).collect()}
    assert gaps == {"a": (9, True, 1), "b": (8, True, 2)}
    d = coverage.coverage_delta(items(spark, [("n", "a", [-1.0, 0.0]), ("o", "a", [1.0, 0.0])]), df).first()
    assert (d.n, d.novel, d.novel_fraction) == (2, 1, 0.5)
    assert coverage.coverage_delta(df.limit(0), df).first().novel_fraction == 0.0
    assert coverage.coverage_delta(df, df.limit(0)).first().novel_fraction == 1.0


def test_active_learning_is_the_greedy_rule(spark):
    rng = np.random.default_rng(3)
    x, e, conf = rng.normal(size=(40, 5)), rng.normal(size=(10, 5)), rng.random(40)
    cand = spark.createDataFrame([(i, "a", v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, conf, strict=True))], "id long, label string, embedding array<double>, confidence double")
    ref = spark.createDataFrame([(100 + i, "a", v.tolist()) for i, v in enumerate(e)], "id long, label string, embedding array<double>")
    u, r = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, e))
    nov = 1 - (u @ r.T).max(1)
    score = 0.5 * (1 - conf) + 0.5 * (nov - nov.min()) / (np.ptp(nov) + 1e-12)
    want, left = [], set(range(40))
    while len(want) < 12:
        i = max(left, key=lambda k: score[k])
        want.append(i)
        left.discard(i)
        score = score - 0.25 * np.maximum(0, u @ u[i])
    for short in (20_000, 12):
        got = [p.id for p in coverage.active_learning(cand, ref, 12, shortlist=short).orderBy("rank").collect()]
        assert got == want


def test_drift(spark):
    a, b = clusters(spark).where("id <> 'bad'"), clusters(spark).where("id <> 'bad'").withColumn("label", F.when(F.col("label") == "a", "b").otherwise("a"))
    assert all(r.shift < 0.01 for r in drift.centroid_shift(a, a).collect())
    g = drift.guard(a, a, b, k=3).first()
    assert g.triggered and list(g.reasons) == ["centroid_shift", "consistency_drop"]
    assert not drift.guard(a, a, a, k=3).first().triggered
    assert drift.drift_type(a.where("label = 'a'"), a.where("label = 'b'")).first().verdict == "both"
    assert drift.drift_type(a, a).first().verdict == "none"


def test_links_never_switch_to_lsh_by_size():
    assert not hasattr(dedup, "choose_links")
