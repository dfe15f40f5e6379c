import zlib

import numpy as np
import pytest

import corpus_pipeline
from curaspark.llm import decontam, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def test_columns_stay(steps):
    _, columns = steps
    assert [k for k, _ in corpus_pipeline.STAGES] and all(c == columns[0] for c in columns[1:-1])


def test_quality_keeps_good_documents(steps, spark):
    rows, _ = steps
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows[1]}
    right = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert np.mean(right) > 0.95
    by_id = {r["doc_id"]: r for r in rows[0]}
    assert all(by_id[r["doc_id"]] == r for r in rows[1])


def test_one_row_for_each_group(steps):
    rows, _ = steps
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows[1]}
    group = {d: d for d in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = min(group[a], group[b])
        if all(group[group[d]] == group[d] for d in group):
            break
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(set(group.values()))


def test_leaks_go_and_others_stay(steps, spark):
    rows, _ = steps
    items = [r.text.split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        text = " ".join(text.split())
        return any(" ".join(w) in text for w in items)

    kept = {r["doc_id"] for r in rows[3]}
    for r in rows[2]:
        if leaks(r["text"]):
            assert r["doc_id"] not in kept
    assert len(kept) >= sum(not leaks(r["text"]) for r in rows[2]) - 2
    assert decontam.MATCH == 2


def test_mix_and_token_files(steps):
    from tokenizers import Tokenizer
    import public_tokenizers

    rows, _ = steps
    copies = {}
    for r in rows[4]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies) <= {r["doc_id"] for r in rows[3]} and max(copies.values()) <= 2
    size = lambda rs: sum(len(r["text"].split()) for r in rs)
    assert size(rows[4]) == pytest.approx(1.5 * size(rows[3]), rel=0.1)
    tok, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(rows[4], key=lambda r: r["doc_id"]):
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r.values()) for r in rows[5]) == sorted(want)


def test_run_gives_the_same(steps, spark):
    rows, _ = steps
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(tuple(r.values()) for r in rows[5])


CLASH = ["h", "key", "size", "source_size", "target", "rate", "copies", "doc", "n", "y", "fp", "component_id", "__kept", "uid", "d", "shard", "start", "score"]


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    """Every stage keeps extra columns whatever their names; null and repeated rows pass by the rules of its operator."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    none = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", None, 0), (901, "", None, "s", None)], docs.schema)
    docs = docs.unionByName(none).unionByName(docs.where("doc_id < 4"))
    for name in CLASH:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    ids = {r.doc_id for r in docs.collect()}
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, SF).cache()
        rows = out.collect()
        assert {r.doc_id for r in rows} <= ids, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            assert all(r[c] == f"own {c}" for r in rows for c in CLASH), name
        if name.startswith("SimHash"):
            assert len(rows) == len({r.doc_id for r in rows})
        at = out
    assert sum(r.n_tokens for r in rows) > 0


def test_empty_documents_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, SF)
        assert out.collect() == [], name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            at = spark.createDataFrame([], out.schema)
