import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.operators import bank, boxes, evaluation, monitor

GT = "image_id string, gt_id long, label string, cx double, cy double, w double, h double"
PRED = "image_id string, pred_id long, label string, cx double, cy double, w double, h double, conf double"


def overlap(a, b):
    w = max(0, min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2))
    h = max(0, min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2))
    u = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / u if u > 0 else 0.0


def plain_match(gt, pred, thr):
    used, out = set(), {}
    for p in sorted(pred, key=lambda p: (-p[7], p[1])):
        best, at = thr, None
        for g in gt:
            if g[0] == p[0] and g[2] == p[2] and (g[0], g[1]) not in used and overlap(p[3:7], g[3:7]) >= best:
                best, at = overlap(p[3:7], g[3:7]), g[1]
        out[p[0], p[1]] = at
        if at is not None:
            used.add((p[0], at))
    return out


def tables(spark, seed=0, n=30):
    r = np.random.default_rng(seed)
    gt, pred = [], []
    for i in range(n):
        for k in range(int(r.integers(0, 5))):
            gt.append((f"i{i}", k, "abc"[int(r.integers(3))], *(float(x) for x in r.uniform(0.3, 0.6, 2)), 0.3, 0.3))
        for k in range(int(r.integers(0, 6))):
            pred.append((f"i{i}", k, "abcd"[int(r.integers(4))], *(float(x) for x in r.uniform(0.3, 0.6, 2)), 0.3, 0.3, round(float(r.random()), 1)))
    return gt, pred, spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)


@pytest.mark.parametrize("thr", [0.3, 0.5])
def test_matching_is_greedy(spark, thr):
    gt, pred, g, p = tables(spark)
    got = {(r.image_id, r.pred_id): r.gt_id for r in evaluation.match(g, p, [thr]).collect()}
    assert got == plain_match(gt, pred, thr)


def test_average_precision(spark):
    gt = [(f"i{k}", 0, "a" if k < 2 else "b", 0.5, 0.5, 0.2, 0.2) for k in range(3)]
    pred = [("i0", 0, "a", 0.5, 0.5, 0.2, 0.2, 0.9), ("i1", 0, "b", 0.5, 0.5, 0.2, 0.2, 0.8)]
    g, p = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)
    m = evaluation.match(g, p)
    aps = {r.label: r.ap for r in evaluation.average_precision(m, g).collect()}
    assert aps == {"a": 0.5, "b": 0.0}
    assert evaluation.mean_ap(evaluation.average_precision(m, g)).first().map == 0.25
    assert [(r.truth, r.pred, r.n) for r in evaluation.confusion(g, p, m).collect()] == [("a", "b", 1)]
    kinds = {r.image_id: r.type for r in evaluation.false_negatives(g, p, m).collect()}
    assert kinds == {"i1": "classification", "i2": "missed"}
    assert [r.type for r in evaluation.false_positives(g, p, m).collect()] == ["paired"]
    assert {r.image_id: (r.n_fp, r.n_fn) for r in evaluation.per_image(g, m).collect()} == {"i0": (0, 0), "i1": (1, 1), "i2": (0, 1)}


def test_precision_stays_in_bounds_and_ignores_order(spark):
    _, _, g, p = tables(spark, 5)
    one = sorted(map(tuple, evaluation.average_precision(evaluation.match(g, p, [0.5, 0.75]), g).collect()))
    two = sorted(map(tuple, evaluation.average_precision(evaluation.match(g.repartition(3), p.orderBy("conf"), [0.5, 0.75]), g).collect()))
    assert one == two and all(0 <= r[4] <= 1 for r in one)


def test_eval_set_hash_sees_truths_only(spark):
    gt, _, g, _ = tables(spark)
    h = evaluation.eval_set_hash(g).first().hash
    assert h == evaluation.eval_set_hash(g.repartition(5)).first().hash and len(h) == 16
    gt[0] = (*gt[0][:3], gt[0][3] + 0.01, *gt[0][4:])
    assert evaluation.eval_set_hash(spark.createDataFrame(gt, GT)).first().hash != h


def test_regression_check_fails_closed(spark):
    ap = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "label string, ap double")
    was = spark.createDataFrame([("a", 0.7), ("b", 0.5)], "label string, ap double")
    n = spark.createDataFrame([("a", 50), ("b", 3)], "label string, n long")
    got = {(r.kind, r.label, r.reason) for r in evaluation.regression_check(ap, was, n, {"a": 0.05, "b": 0.05}).collect()}
    assert got == {("blocking", None, "map_drop"), ("blocking", "a", "protected_drop"), ("blocking", "b", "protected_support")}
    assert [r.kind for r in evaluation.regression_check(ap, was, n, set_changed=True).collect()] == ["advisory"]


def test_box_audit(spark):
    rows = [(f"n{i}", "car", 0.5, 0.5, 0.1 + 0.001 * i, 0.1) for i in range(12)] + [("flat", "car", 0.5, 0.5, 0.0008, 0.1), ("edge", "car", 0.05, 0.5, 0.16, 0.1), ("huge", "car", 0.5, 0.5, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "id string, label string, cx double, cy double, w double, h double")
    got = [(r.id, r.issue) for r in boxes.audit(df).collect()]
    assert got[0] == ("flat", "degenerate") and got[1] == ("edge", "truncated") and ("huge", "area_outlier") in got
    assert boxes.audit(df.limit(0)).collect() == []


def test_nms_is_greedy(spark):
    _, pred, _, p = tables(spark, 2)
    want = set()
    for image in {x[0] for x in pred}:
        kept = []
        for d in sorted((x for x in pred if x[0] == image), key=lambda d: (-d[7], d[1])):
            if all(overlap(d[3:7], k[3:7]) < 0.5 for k in kept):
                kept.append(d)
        want |= {(image, d[1]) for d in kept}
    assert {(r.image_id, r.pred_id) for r in boxes.loose_nms(p, 0.5).collect()} == want


def test_control_charts(spark):
    xs = [0.05] * 10 + [0.2] * 10
    r = monitor.spc(monitor.series(spark.createDataFrame(list(enumerate(xs)), "t int, x double"), "t", "x")).first()
    assert r.ewma_index >= 10 and r.cusum_index >= 10 and not r.short
    assert monitor.spc(monitor.series(spark.createDataFrame([], "t int, x double"), "t", "x")).collect() == []


def test_calibration(spark):
    r = np.random.default_rng(0)
    conf = r.uniform(0.9, 0.99, 400)
    y = (r.random(400) < 0.7).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(conf, y, strict=True)], "conf double, correct double")
    t = monitor.fit_temperature(df).first().temperature

    def loss(t):
        p = np.clip(1 / (1 + np.exp(-np.log(conf / (1 - conf)) / t)), 1e-6, 1 - 1e-6)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grid = np.linspace(0.05, 10, 4000)
    assert t == pytest.approx(grid[np.argmin([loss(g) for g in grid])], abs=0.01) and t > 1
    assert monitor.fit_temperature(df.limit(0)).first().temperature == 1.0
    assert monitor.calibration_error(df).first().ece > 0.1
    assert monitor.calibration_error(df.limit(0)).first().ece == 0.0
    cost = monitor.cost_gate(spark.createDataFrame([(0.01, 0.1), (0.011, 0.1)], "miss_rate double, fa_rate double"), 100, 1, 1.1).collect()
    assert [(r.expected_cost, r.verdict) for r in cost] == [(1.1, "GO"), (1.2, "NO-GO")]


def test_banks(spark):
    r = np.random.default_rng(1)
    base = np.eye(4)
    rows = [(f"{n}{i}", n, (base[k] + r.normal(0, 0.02, 4)).tolist()) for k, n in enumerate(("defect", "normal")) for i in range(8)]
    banks = spark.createDataFrame(rows, "id string, bank string, embedding array<double>")
    q = spark.createDataFrame([("d", base[0].tolist()), ("n", base[1].tolist()), ("far", base[2].tolist()), ("zero", [0.0] * 4)], "id string, embedding array<double>")
    got = bank.vote(q, banks, bank.bank_scales(banks), 5, verdicts={"defect": "defect_like"})
    assert {x.id: x.verdict for x in got.collect()} == {"d": "defect_like", "n": "normal", "far": "unknown", "zero": "unknown"}
    ev = bank.evidence(q, banks, got, 3).collect()
    assert {e.id for e in ev} == {"d", "n"} and max(e["rank"] for e in ev) == 3


def pair(spark, sigma, n=25):
    r = np.random.default_rng(0)
    rows = [(f"{c}{i}", c, (np.eye(4)[k] + r.normal(0, sigma, 4)).tolist()) for k, c in enumerate("ab") for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string, embedding array<double>")


def test_shares_of_pairs_keep_no_neighbours(spark, monkeypatch):
    r = np.random.default_rng(3)
    m = np.concatenate([r.normal(size=(90, 4)), np.repeat(r.normal(size=(2, 4)), 15, axis=0)]).astype(np.float32).astype(float)
    label = r.choice(list("abcd"), len(m), p=(0.5, 0.3, 0.15, 0.05))
    df = spark.createDataFrame([(i, str(c), v.tolist()) for i, (c, v) in enumerate(zip(label, m, strict=True))] + [(500, "a", None), (501, "z", None)], "id long, label string, embedding array<double>")
    pairs = spark.createDataFrame([("a", "b", 7), ("b", "c", 3), ("a", "d", 5), ("c", "d", 1)], "a string, b string, k int")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s, want = np.round(u @ u.T, 9), {}
    for a, b, k in (("a", "b", 7), ("b", "c", 3), ("a", "d", 5), ("c", "d", 1)):
        both = [i for i in range(len(m)) if label[i] in (a, b)]
        for i in both:
            near = sorted((j for j in both if j != i), key=lambda j: (-s[i, j], label[j], j))[:k]
            want[a, b, i, str(label[i])] = round(sum(label[j] == b for j in near) / len(near), 9)
    assert len({x.share for x in bank.other_shares(df, pairs).collect()}) > 3
    monkeypatch.setattr(bank.vectors, "knn", None)  # no list of neighbours leaves a task
    for how in ({}, {"broadcast_bytes": 0, "block": 16}, {"block": 50}, {"broadcast_bytes": 0, "state_bytes": 8 * 7 * 4 * 10}):
        got = bank.other_shares(df, pairs, **how).collect()
        assert {(x.a, x.b, x.id, x.label): round(x.share, 9) for x in got} == want and len(got) == len(want)
    wide = df.withColumn("embedding", F.transform("embedding", lambda x: x * 1.1))  # no single-precision vectors
    assert {(x.a, x.b, x.id, x.label): round(x.share, 9) for x in bank.other_shares(wide, pairs).collect()} == want
    assert bank.separability(df.limit(0)).collect() == [] == bank.separability(df.where("label = 'a'")).collect()


def test_separability_is_pair_stats_without_intervals(spark):
    st = bank.pair_stats(pair(spark, 1.0))
    got = bank.separability(pair(spark, 1.0))
    assert got.collect() == st.select(*got.columns).collect()


@pytest.mark.parametrize("sigma,confused,verdicts", [(0.05, 10, {"model"}), (0.05, 0, set()), (3.0, 10, {"taxonomy", "taxonomy_watch", "label_noise"})])
def test_attribution(spark, sigma, confused, verdicts):
    st = bank.pair_stats(pair(spark, sigma))
    conf = spark.createDataFrame([("a", "b", confused)], "truth string, pred string, n long")
    n_gt = spark.createDataFrame([("a", 20), ("b", 20)], "label string, n long")
    got = {r.verdict for r in bank.attribute(st, conf, n_gt).collect()}
    assert got <= verdicts and bool(got) == bool(verdicts)
    assert bank.pair_stats(pair(spark, sigma)).first() == st.first()


def test_projection(spark):
    ad = bank.adaptation(pair(spark, 0.05))
    assert ad.first().frozen_err == 0.0
    assert not bank.projection_gate(ad).first().go
    x, y = np.random.default_rng(0).normal(size=(60, 5)), np.repeat([0, 1, 2], 20)
    x[y == 1, 0] += 4
    x[y == 2, 1] += 4
    df = spark.createDataFrame([(i, "abc"[c], v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, label string, embedding array<double>").repartition(3)
    mean, w = bank.fit_projection(df)
    assert mean == pytest.approx(x.mean(axis=0)) and w.shape == (5, 2)
    # the directions solve the generalised eigenproblem of the two scatters
    gaps = np.stack([x[y == c].mean(axis=0) for c in range(3)]) - mean
    between = 20 * gaps.T @ gaps
    within = (x - mean).T @ (x - mean) - between
    within += 0.3 * (np.trace(within) / 5 + 1e-9) * np.eye(5)
    for v in w.T:
        ratio = (v @ between @ v) / (v @ within @ v)
        assert between @ v == pytest.approx(ratio * (within @ v), abs=1e-6) and np.linalg.norm(v) == pytest.approx(1)
    out = bank.project(df.where("id = 0"), mean, w).first()
    assert out.embedding == pytest.approx((x[0] - mean) @ w)
    assert bank.fit_projection(df.where("label = 'a'"))[1] is None and bank.fit_projection(df.limit(0))[1] is None
