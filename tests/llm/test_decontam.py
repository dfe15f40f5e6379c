import numpy as np
import pytest

from curaspark.llm import decontam

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "se", "ta", "vo") for b in ("ne", "ri", "sol", "tan", "ub", "wex")]


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    pairs = [(rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 40))) for _ in range(60)]
    got = decontam.align_many([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), s in zip(pairs, got.tolist(), strict=True):
        assert s == plain_score(a, b)
        score, first, last, matched = decontam.trace(a, b)
        assert score == s and (not s or 0 <= first <= last < len(b)) and matched * 2 >= s


def text(rng, n):
    return list(rng.choice(WORDS, n))


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["other"] if x < share else [w]
    return out


@pytest.mark.parametrize("slice_chars", [8_000_000, 900])
def test_finds_copies_and_leaves_others(spark, slice_chars):
    rng = np.random.default_rng(1)
    items = [(k, " ".join(text(rng, 30))) for k in range(20)] + [(98, "too short"), (99, None), (None, "x y z w"), (97, "")]
    docs, want = [], set()
    for k in range(200):
        words = text(rng, 150)
        if k % 4 == 0:
            item = 3 if k % 8 == 0 else int(rng.integers(20))  # one passage is very common
            piece = items[item][1].split()
            piece = piece if k % 12 else edited(rng, piece, 0.2)
            words[40:40] = [w.upper() + "," if k % 20 == 0 else w for w in piece]
            want.add((k, item))
        docs.append((k, " ".join(words), "x"))
    docs += [(500, None, ""), (None, items[5][1], ""), (501, "", ""), (502, "word " * 100_000 + items[7][1], ""), (502, "word " * 100_000 + items[7][1], "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(df, bench, slice_chars=slice_chars).collect()
    pairs = sorted((str(r.doc_id), r.item_id) for r in got)
    assert pairs == sorted([*((str(a), b) for a, b in want), ("None", 5), ("502", 7), ("502", 7)])
    long = next(r for r in got if r.doc_id == 502)
    assert (long.first_word, long.last_word, long.matched_words, long.score) == (100_000, 100_029, 30, 1.0)
    kept = decontam.clean(df, bench, slice_chars=slice_chars)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(k) for k in range(200) if k % 4), "500", "501"])


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert decontam.contaminated(df, bench.limit(0)).collect() == []
    assert decontam.contaminated(df.limit(0), bench).collect() == []
    assert decontam.clean(df, bench.limit(0)).count() == 1
