import numpy as np
import pytest

from curaspark.llm import topk


def plain(rows, queries, k):
    out = []
    for i, q in queries:
        best = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in rows if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale,dim,n", [(256, 8, 400), (3, 4, 300), (2**28, 5, 60), (10, 1, 50)])
def test_matches_brute_force(spark, scale, dim, n):
    rng = np.random.default_rng(scale)
    rows = [(i, [int(x) for x in rng.integers(-scale, scale + 1, dim)]) for i in rng.permutation(n).tolist()]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # a very common vector
    rows.append((2000, [0] * dim))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    queries = [r for r in rows if r[0] % 10 == 0]
    got = topk.search(df, df.where("vec_id % 10 = 0"), block=64, query_block=16)
    assert sorted(map(tuple, got.collect())) == plain(rows, queries, 5)


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 20, (4000, 3))
    rows[7] = [500, 500, 500]
    rows[9] = [400, 500, 500]
    stats = {}
    lists = topk.Lists(np.arange(4000), rows)
    assert topk.threshold(lists, -1, np.array([1, 2, 1]), 2, [], stats) == [(2000, 7), (1900, 9)]
    assert stats["scored"] < 1000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], "a"), (1, [0.5, None], "a"), (2, None, "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (None, [0.5, 0.25], "a"), (5, [0.5, 0.25], "a"), (5, [0.5, 0.25], "b"), (50, [0.25], "c"), (6, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    v = df.where(topk.usable(df.embedding)).select("vec_id", topk.quantised(df.embedding).alias("embedding"))
    got = sorted(map(tuple, topk.search(v, v.where("vec_id % 50 = 0")).collect()))
    # rows that repeat are candidates each, as every row is
    assert got == [(0, 1, 5, 20480), (0, 2, 5, 20480), (0, 3, 50, 8192), (0, 4, 6, 0), (50, 1, 0, 8192), (50, 2, 5, 8192), (50, 3, 5, 8192), (50, 4, 6, 0)]
    twice = v.unionByName(v.where("vec_id = 0"))
    assert [r for r in sorted(map(tuple, topk.search(twice, twice.where("vec_id % 50 = 0")).collect())) if r[0] == 0] == [r for r in got if r[0] == 0]
    assert topk.search(v.limit(0), v.limit(0)).collect() == []
