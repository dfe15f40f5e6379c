import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from curaspark.llm import buckets, simhash

SCHEMA = "doc_id long, text string, a string, fp string"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = Counter(j for g in grams for j in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> j & 1)
    return sum(1 << j for j in range(64) if votes[j] * 2 > len(grams))


def plain_components(fps):
    parent = {d: d for d, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, f) in enumerate(fps):
        for e, g in fps[:i]:
            if (f ^ g).bit_count() <= 3:
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in parent}


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "Two WORDS", "a b c", "x " * 5000, "É à Ü straße x y z w", "the cat sat\ton the\x0bmat " * 40])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", range(8))
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 70, dtype=np.uint64)
    b = np.concatenate([a[:40] ^ np.array([sum(1 << int(x) for x in rng.choice(64, k % 9, replace=False)) for k in range(40)], np.uint64), rng.integers(0, 2**63, 90, dtype=np.uint64)])
    want = np.array([[(int(x) ^ int(y)).bit_count() <= radius for y in b] for x in a])
    assert (simhash.within(a, b, radius) == want).all()
    assert (simhash.within(a, b, radius, words=1) == want).all()


def test_components_of_paths_stars_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 400), (400, 500)]
    got = {r.node: r.component for r in buckets.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 400: 400, 500: 400}


@pytest.mark.parametrize("cap", [4, 1024])
def test_components_match_brute_force(spark, cap):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = []
    for k in range(150):
        t = base[k % 12].split()
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(len(t)))] = "edit"
        rows.append((1000 - k, " ".join(t), "x", "y"))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), cap=cap).collect()}
    fps = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    assert {d: r.component_id for d, r in got.items()} == plain_components(fps)
    assert {d: r.fp % 2**64 for d, r in got.items()} == dict(fps)


def test_nulls_repeats_and_empty(spark):
    rows = [(5, None, "", ""), (3, "", "", ""), (None, "same words here today", "", ""), (9, "same words here today", "", ""), (9, "same words here today", "", ""), (None, "alone in this one", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("5", "3"), ("9", "9"), ("9", "9"), ("None", "9"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    kept = simhash.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "9", "None", "None"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "a", "fp"}
