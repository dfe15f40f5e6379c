import math

import duckdb
import numpy as np
import pytest

from curaspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, rate string, g string"

TARGET_SQL = """
    with sized as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents
    ), sums as (
        select source, sum(size) as size from sized group by source
    ), ranked as (
        select *, 2.0 * size as ceiling, row_number() over (order by source nulls last) as rank, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w,
               1.5 * sum(size) over () as budget
        from sums
    ), ordered as (
        select *, (budget - coalesce(sum(ceiling) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
        from ranked window before as (order by ceiling / w, rank rows between unbounded preceding and 1 preceding)
    ), water as (
        select coalesce(arg_min(level, ceiling / w) filter (ceiling / w >= level), 1e300) as level from ordered
    )
    select d.doc_id, d.size, s.size as source_size, least(ceiling, water.level * w) as target
    from sized d join ranked s on d.source is not distinct from s.source, water
"""


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


def plain_rates(n, target, limit=2.0):
    """Rates of one source by bisection on the multiplier, document by document."""
    n = np.asarray(n, float)
    if target <= 0 or target >= limit * n.sum():
        return np.full(len(n), limit if target > 0 else 0.0)
    lo, hi = -1e4, 1e4
    for _ in range(300):
        mid = (lo + hi) / 2
        r = np.minimum(limit, np.exp(np.minimum(mid * n / n.mean(), 1.0)))
        lo, hi = (lo, mid) if (r * n).sum() > target else (mid, hi)
    return r


def corpus():
    rows = []
    for k in range(3000):
        source = ["hot", "b", "c", None, "dé", "Z", "\U0001f600"][0 if k % 3 == 0 else k % 7]
        rows.append((k, None if k == 11 else "w " * (k * 37 % 211), source, "x", "y", "z"))
    return rows + [rows[5]] * 4


def test_mix_meets_targets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(df, keep=["doc_id", "source"]).selectExpr("doc.*", "size", "source_size", "target", "rate", "copies").collect()
    assert len(got) == len(rows)
    by, taken = {}, {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        assert 0 <= r.copies <= 2 and (r["size"] == 0 or math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    want = plain_targets(sizes)
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {sizes[s]}
        assert [r.target for r in rs] == pytest.approx([want[s]] * len(rs), rel=1e-9)
        assert sum(r.rate * r["size"] for r in rs) == pytest.approx(want[s], rel=1e-8)
        rs = [r for r in rs if r["size"]]
        assert [r.rate for r in rs] == pytest.approx(plain_rates([r["size"] for r in rs], want[s]), rel=1e-6)
        if want[s] < 2 * sizes[s]:
            assert len({r.rate for r in rs}) > 20  # documents of one source differ
        assert abs(taken[s] - want[s]) <= 10
    again = mixing.mixed(df.repartition(3), keep=["doc_id"]).selectExpr("doc.doc_id", "copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)
    mix = mixing.expanded(mixing.mixed(df))
    assert mix.columns == df.columns
    assert mix.count() == sum(r.copies for r in got)


def test_no_other_rates_have_less_entropy():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 300, 200).astype(float)
    cost = lambda r: (r * np.log(np.maximum(r, 1e-300)) - r + 1).sum()
    for share in (0.2, 0.9, 1.4, 1.95):
        r = plain_rates(n, share * n.sum())
        for _ in range(300):
            d = rng.normal(0, 1e-3, len(n))
            d -= n * (d @ n) / (n @ n)  # words taken stay as they are
            other = r + d
            if (other >= 0).all() and (other <= 2).all():
                assert cost(other) >= cost(r) - 1e-12


def test_sizes_and_targets_are_those_of_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mixed(docs, keep=["doc_id"]).selectExpr("doc.doc_id", "size", "source_size", "target").collect()
    duckdb.sql("create or replace view documents as from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(duckdb.sql(TARGET_SQL).fetchall())
    assert [tuple(r)[:3] for r in sorted(got)] == [r[:3] for r in want]
    assert [r.target for r in sorted(got)] == pytest.approx([r[3] for r in want])


def test_repeated_rows_of_one_hot_cell(spark):
    """A third of the rows are one row; lengths of a hot cell all tie. The edge runs through the repeats."""
    rows = [(1, "a b c", "s", "", "", "")] * 5000 + [(k, "a b c", "s", "", "", "") for k in range(2, 400)] + [(k, "w " * 40, "t", "", "", "") for k in range(1000, 1300)] + [(None, None, "t", "", "", "")] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    mixes = [mixing.mixed(x, keep=keep, weights=(2, 1)).selectExpr("doc.doc_id", "size", "target", "copies").collect() for x, keep in ((df, ["doc_id"]), (df.repartition(7), None))]
    for got in mixes:
        assert len(got) == len(rows)
        for size in (3, 40):
            mine = [r for r in got if r["size"] == size]
            assert abs(sum(r.copies * size for r in mine) - mine[0].target) <= size
        assert len({r.copies for r in got if r.doc_id == 1}) <= 2
    assert sorted((r.doc_id or 0, r.copies) for r in mixes[0]) == sorted((r.doc_id or 0, r.copies) for r in mixes[1])


def test_thresholds_pick_the_least_hashes(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63 - 1, 900)
    h[100:400] = h[100]  # a repeated row
    rows = spark.createDataFrame([("=s", 7, int(x)) for x in h], "key string, size long, h long")
    order = sorted(h.tolist())
    for extra in (1, 37, 450, 600, 899):
        cells = spark.createDataFrame([("=s", 7, 900, extra)], "key string, size long, n long, extra long")
        (r,) = mixing.thresholds(rows, cells).collect()
        assert r.edge == order[extra - 1] and r.m == order.count(r.edge) and r.q == extra - sum(x < r.edge for x in order)


def test_empty_and_blank(spark):
    df = spark.createDataFrame([(1, None, None, "", "", ""), (2, "", "a", "", "", "")], SCHEMA)
    assert [(r["size"], r.target, r.copies) for r in mixing.mixed(df).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed(df.limit(0)).collect() == []
