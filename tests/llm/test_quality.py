import numpy as np
import pytest

from curaspark.llm import quality

DOCS = "doc_id long, text string, n_chars long, score string, y string, lang string"


def tables(spark, n=300):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{int(x)}" for x in rng.integers(0, 80, 40)]
        good = k % 3 != 0
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((k, text, len(text), "a", "b", "c"))
        labels.append((k, int(good)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 8)))
    idx, val = quality.features("some words of some text, here", 30)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(len(idx)) for j in range(i))
    assert m.raw(idx, val) == pytest.approx(0.3 + m.w[idx] @ val + pairs)


def test_learns_held_out_rows_and_keeps_the_rest(spark):
    docs, labels = tables(spark)
    m = quality.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r.score for r in quality.scored(docs, m).collect()}
    assert np.mean([(got[d] >= 0.5) == (truth[d] == 1) for d in truth]) > 0.97
    kept = quality.accepted(docs, m)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, s in got.items() if s >= 0.5}


def test_odd_rows_and_missing_labels(spark):
    docs, labels = tables(spark, 60)
    odd = spark.createDataFrame([(None, None, None, None, None, None), (900, "", 0, "", "", ""), (901, "é" * 200_000, -5, "", "", ""), (901, " \n\t", 3, "", "", "")], DOCS)
    m = quality.fit(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1), (901, None)], "doc_id long, quality int")))
    got = quality.scored(odd, m).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    one = quality.fit(docs, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in quality.scored(docs, one).collect())
    assert quality.scored(docs.limit(0), m).collect() == []
