import numpy as np
import pytest

from curaspark.llm import passages

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "se") for b in ("ne", "ri", "sol", "tan", "ub") for c in ("", "x", "th", "ing")]
SCHEMA = "doc_id long, text string, removed string, n long"


def words(rng, n):
    return list(rng.choice(WORDS, n))


def plain_jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_bands_reach_their_recall():
    b = passages.bands_for(3, 0.8, 0.99)
    assert 1 - (1 - 0.8**3) ** b >= 0.99 > 1 - (1 - 0.8**3) ** (b - 1)
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(200):
        shared = rng.integers(0, 2**32, 80, dtype=np.uint32)
        x, y = (np.unique(np.concatenate([shared, rng.integers(0, 2**32, 10, dtype=np.uint32)])) for _ in "ab")
        met += bool(set(passages.band_keys(x, b, 3).tolist()) & set(passages.band_keys(y, b, 3).tolist()))
    assert met >= 192


def test_cluster_is_exact_jaccard():
    rng = np.random.default_rng(1)
    base = [words(rng, 70) for _ in range(6)]
    texts = []
    for k in range(60):
        w = list(base[k % 6])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = "changed"
        texts.append(w)
    sets = [passages.shingle_hashes(passages.word_hashes(" ".join(w).encode())[0]) for w in texts]
    lab = passages.cluster(sets, 0.8)
    want = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if plain_jaccard(texts[i], texts[j]) >= 0.8:
                    want[i] = want[j] = min(want[i], want[j])
    assert lab.tolist() == want


def test_span_keys_do_not_depend_on_the_place():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 500, dtype=np.uint64)
    moved = np.concatenate([rng.integers(0, 2**63, 77, dtype=np.uint64), h[100:160], h[:9]])
    with np.errstate(over="ignore"):
        assert passages.span_keys(h, np.array([100]), np.array([160])) == passages.span_keys(moved, np.array([77]), np.array([137]))
        assert passages.span_keys(h, np.array([100]), np.array([159])) != passages.span_keys(moved, np.array([77]), np.array([137]))


@pytest.mark.parametrize("cap", [3, 1024])
def test_planted_passages(spark, cap):
    rng = np.random.default_rng(3)
    rows, shared = [], [words(rng, int(n)) for n in rng.integers(52, 120, 12)]
    boiler = "this line is in every one of them"
    planted = {}
    for d in range(90):
        w = words(rng, 200)
        if d % 3 == 0:
            p = 0 if d % 2 else d // 3 % 12
            at = int(rng.integers(10, 180))
            w[at:at] = shared[p]
            planted.setdefault(p, []).append(d)
        rows.append((d, boiler + "\n" + " ".join(w), "x", 1))
    line = words(rng, 80)
    for d in (200, 201, 202):  # edited copies of one line
        w = list(line)
        w[d - 190] = "edited"
        rows.append((d, " ".join(words(rng, 20)) + "\n" + " ".join(w) + "\n" + " ".join(words(rng, 15)), "x", 1))
    rows += [(300, None, "", 0), (301, "", "", 0), (302, "a b", "", 0), (None, " ".join(shared[4]), "", 0), (0, rows[0][1], "x", 1), (303, "again " * 60_000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = passages.repeated(df, cap=cap).collect()
    flagged = {r.doc_id for r in got}
    many = {d for p, ds in planted.items() if len(ds) > 1 for d in ds}
    assert flagged - {None} == many | {200, 201, 202}
    assert None in flagged
    classes = {}
    for r in got:
        classes.setdefault(r.component_id, set()).add(r.doc_id)
        assert r.removed == (r.doc_id != r.first_doc_id) and r.passage_n_words >= 51
    for p, ds in planted.items():
        if len(ds) > 1:
            assert any(set(ds) <= c for c in classes.values()), p
    assert any({200, 201, 202} <= c for c in classes.values())
    assert passages.repeated(df.limit(0)).collect() == []


def test_passages_inside_differing_lines_to_their_true_ends(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    rows, want = [], {}
    for p in range(400):
        shared = list(rng.choice(vocabulary, 51 + p % 5))
        for d in (2 * p, 2 * p + 1):
            before, after = (list(rng.choice(vocabulary, int(n))) for n in rng.integers(10, 60, 2))
            rows.append((d, " ".join(before + shared + after), "", 0))
            want[d] = (len(before), len(shared))
    got = {}
    for r in passages.repeated(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, set()).add((r.passage_first_word, r.passage_n_words))
    assert all(got[d] == {want[d]} for d in got)
    assert len(got) >= 0.98 * len(want)


def test_stacked_short_lines_are_left_alone(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    lines = [" ".join(rng.choice(vocabulary, 18)) for _ in range(60)]
    rows = [(d, "\n".join(lines[k] for k in rng.choice(60, 5, replace=False)), "", 0) for d in range(40)]
    pairs = {}
    for d, text, _, _ in rows:
        for x in zip(text.split("\n"), text.split("\n")[1:]):
            pairs.setdefault(x, set()).add(d)
    stacked = {d for ds in pairs.values() if len(ds) > 1 for d in ds}
    assert {r.doc_id for r in passages.repeated(spark.createDataFrame(rows, SCHEMA)).collect()} <= stacked


def test_near_copies_of_short_lines_and_over_gaps(spark):
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    some = lambda n: list(rng.choice(vocabulary, n))
    rows, lines, wrapped = [], set(), set()
    for p in range(60):
        w = some(int(rng.integers(53, 80)))
        for d, x in ((2 * p, w), (2 * p + 1, ["other", *w[1:]] if p % 2 else [*w, "more"])):
            rows.append((d, "\n".join(" ".join(v) for v in (some(20), x, some(20))), "", 0))
            lines.add(d)
    for p in range(60, 90):
        w = some(150)
        for d in (2 * p, 2 * p + 1):
            x = list(w)
            if d % 2:
                for k in (50, 100):
                    x[k] = "edited"
            rows.append((d, "\n".join(" ".join(x[k : k + 11]) for k in range(0, 150, 11)), "", 0))
            wrapped.add(d)
    got = {}
    for r in passages.repeated(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.doc_id] = max(got.get(r.doc_id, 0), r.passage_n_words)
    assert lines <= got.keys()
    assert np.mean([got.get(d, 0) >= 100 for d in wrapped]) >= 0.9


def test_paragraphs_of_every_size_against_all_pairs(spark):
    """Edited copies of lines of 1 to 200 words: classes against components of plain Jaccard over all pairs."""
    rng = np.random.default_rng(7)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    some = lambda n: list(rng.choice(vocabulary, n))
    texts = []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 48, 75, 120, 200):
        for _ in range(25):
            w = some(n)
            texts.append(w)
            kind = int(rng.integers(5))
            x = list(w)
            if kind == 0:
                x = [*w, "more"]
            elif kind == 1:
                x = w[1:] or w
            elif kind == 2:
                x[0] = "first"
            elif kind == 3:
                for at in rng.integers(0, n, max(1, n // 60)):
                    x[at] = "edited"
            texts.append(x)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    linked, lab = [], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                linked.append((j, i))
    for _ in range(10):
        for j, i in linked:
            lab[i] = lab[j] = min(lab[i], lab[j])
    rows = [(k, " ".join(w), "", 0) for k, w in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in passages.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(texts)
    by_class = {}
    for k, c in got.items():
        by_class.setdefault(c, set()).add(lab[k])
    assert all(len(x) == 1 for x in by_class.values())  # nothing linked that plain Jaccard doesn't link
    found = {}
    for j, i in linked:
        found.setdefault(len(texts[j]), []).append(got[i] == got[j])
    assert set(found) >= {1, 4, 7, 8, 9, 10, 12, 15, 20, 30, 48, 75, 120, 200}
    assert all(np.mean(x) >= 0.9 for x in found.values()), {n: np.mean(x) for n, x in found.items()}
    assert np.mean([x for xs in found.values() for x in xs]) >= 0.99


def test_lines_that_can_resemble_an_unequal_one():
    assert passages.banded_from(0.8, 5) == 8 and passages.banded_from(0.5, 5) == 5


def test_bands_of_lines_are_those_of_their_sets():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**63, 400, dtype=np.uint64)
    starts, stops = np.array([0, 8, 30, 130]), np.array([8, 30, 130, 400])
    with np.errstate(over="ignore"):
        got = passages.line_bands(h, starts, stops, 5, 7, 3)
        for row, i, j in zip(got, starts, stops, strict=True):
            assert row.tolist() == passages.band_keys(passages.shingle_hashes(h[i:j]), 7, 3).tolist()


def test_shingles_by_join_and_by_broadcast_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(d, "\n".join(" ".join(words(rng, int(n))) for n in rng.integers(1, 60, 6)), "", 0) for d in range(40)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = passages.units(df, "doc_id", "text", 51, 0.8, 5, 7, 3).where("is_line and n >= 8").cache()
    met = lines.where("key % 2 = 0").select("key").distinct()
    got = []
    for limit in (1 << 20, 0):
        monkeypatch.setattr(passages, "BROADCAST_BYTES", limit)
        got.append(sorted((r.key, bytes(r.grams)) for r in passages.line_shingles(df, "doc_id", "text", lines, met, 5).collect()))
    assert got[0] == got[1] and len(got[0]) == met.count()


def test_every_document_that_shares_a_run_of_words(spark):
    """Against brute force over all runs of 51 words: passages shared with a pair of copies, runs of one word, runs that begin anywhere."""
    rng = np.random.default_rng(10)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    some = lambda n: list(rng.choice(vocabulary, n))
    texts = []
    for p in range(60):
        w = some(300)
        texts += [w, list(w), [*some(40), *w[100 : 100 + 51 + p % 9], *some(30)]]  # two copies, and one that shares a part
    for p in range(20):
        texts.append([*some(20), *["the"] * int(rng.integers(52, 200)), *some(20)])
        texts.append([*some(20), *["a", "b", "c"] * int(rng.integers(30, 60)), *some(20)])
    texts += [some(120) for _ in range(60)]
    runs = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - 50):
            runs.setdefault(tuple(w[i : i + 51]), set()).add(d)
    want = {d for ds in runs.values() if len(ds) > 1 for d in ds}
    got = {r.doc_id for r in passages.repeated(spark.createDataFrame([(d, " ".join(w), "", 0) for d, w in enumerate(texts)], SCHEMA)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_words_of_a_stream_are_those_of_its_texts(monkeypatch):
    """Texts that lie in a row, against plain splitting: which words are the same, whose they are and where lines begin."""
    rng = np.random.default_rng(11)
    some = ["", " \n\t", "one", "--", "One,", "(one)", "-one-two-", "Äpfel", "äpfel", "***", "*", "x" * 5000, "a\x0bb\x0cc\rd", "\n\none two\n \nthree.", "two\n"]
    texts = [t.encode() for t in some] + [" ".join(rng.choice(some, 30)).encode() for _ in range(40)]
    plain = [[w.strip(passages.EDGES) or w for w in t.lower().split()] for t in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    with np.errstate(over="ignore"):
        h, docs, lines = passages.word_stream(raw, bounds)
        in_pieces = passages._byte_hashes
        monkeypatch.setattr(passages, "_byte_hashes", lambda raw, lo, hi: in_pieces(raw, lo, hi, 7))
        assert passages.word_stream(raw, bounds)[0].tolist() == h.tolist()
    assert np.diff(docs).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    assert np.diff(lines).tolist() == [len(x.split()) for t in texts for x in t.split(b"\n") if x.split()]
    assert passages.word_hashes(None)[0].tolist() == []


def test_few_sets_and_many_are_clustered_alike():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**32, (5, 60), dtype=np.uint32)
    for _ in range(20):
        sets = [np.unique(np.concatenate([base[k % 5], rng.integers(0, 2**32, int(rng.integers(0, 16)), dtype=np.uint32)])) for k in range(30)]
        few = passages.cluster(sets, 0.8)
        far = [np.arange(k * 1000, k * 1000 + 5, dtype=np.uint32) for k in range(1, 41)]  # over 64 sets are searched one by one
        assert passages.cluster(sets + far, 0.8).tolist() == [*few.tolist(), *range(30, 70)]


def test_windows_over_a_paragraph_of_its_own_stay_closed(spark):
    """A copy with one word edited: all shared windows open, few of those with the edit do."""
    rng = np.random.default_rng(13)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    rows = []
    for p in range(40):
        w = list(rng.choice(vocabulary, 250))
        rows += [(2 * p, " ".join(w), "", 0), (2 * p + 1, " ".join([*w[:125], "edited", *w[126:]]), "", 0)]
    docs, near = {}, {}
    for r in passages.units(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 51, 0.8, 5, 7, 3).where("not is_line").collect():
        docs.setdefault(r.key, set()).add(r.d)
        near.setdefault(r.d, []).append(r)
    texts = [(d, d, text.encode(), [(r.start, r.n, False) for r in near[d] if len(docs[r.key]) > 1]) for d, text, _, _ in rows]
    table = spark.createDataFrame(texts, "uid long, d long, text binary, near array<struct<start: int, n: int, told: boolean>>")
    open_ = {}
    for r in passages.windows(table, 51, 5, 7, 3).where("bands is null").collect():
        open_.setdefault(r.d, set()).add(r.start)
    shared = set(range(125 - 50)) | set(range(126, 200))
    assert np.mean([len(shared & open_[d]) / len(shared) for d in open_]) > 0.9
    assert all(open_[d] >= set(range(40, 75)) | set(range(126, 160)) for d in open_)
    assert np.mean([len(open_[d] - shared) for d in open_]) < 35


def test_staged_tables_go_when_they_are_used_up(spark):
    rng = np.random.default_rng(14)
    shared = words(rng, 60)
    df = spark.createDataFrame([(d, " ".join([*words(rng, 30), *shared, *words(rng, 30)]), "", 0) for d in range(4)], SCHEMA)
    point = passages.runtime.mark()
    found = passages.repeated(df)
    left = {x.rpartition("/")[2].rpartition("-")[0] for x in passages.runtime._made[point:]}
    assert left == {"shorts", "shorts-chained", "windows-met", "lines-classed"}
    assert {r.doc_id for r in found.collect()} == {0, 1, 2, 3}
