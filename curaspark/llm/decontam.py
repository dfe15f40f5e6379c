"""Benchmark decontamination by rare seeds and Smith-Waterman alignment (operator 3).

Word n-grams of the test items are counted over all documents; in every stretch of consecutive n-grams of an item the rarest
becomes a seed, so each stretch of an item has one however common its passage is in the corpus. Seeds found in a document
point to the region in which the item would lie, and a Smith-Waterman alignment over words scores it: copies that were
edited, shortened or paraphrased keep a high share of the best possible score.

The seed index of a slice of test items is what gets broadcast, at most ``slice_chars`` characters of items; a larger
benchmark goes through in several slices. Cases: null or empty texts, and items of fewer words than a seed, match nothing;
a null document id is kept in the result; repeated rows each report their items; repeated items report under each id;
empty tables give an empty result; very long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…*#$%&|_-–—"
MATCH, MISMATCH, GAP = 2, -1, -1


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


class Items:
    """Word ids and seed index of a slice of test items."""

    def __init__(self, items: list[tuple[int, str]], n: int = 3):
        self.n, self.vocab = n, {}
        self.ids, self.words = [], []
        for item, text in items:
            ws = [w for w in map(plain, (text or "").split()) if w]
            if item is not None and len(ws) >= n:
                self.ids.append(item)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64))
        self.base = len(self.vocab) + 1
        grams = [self.keys(w) for w in self.words]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        self.places = grams

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram; n-grams with a word that no item has are -1."""
        if len(ids) < self.n:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(ids) - self.n + 1, np.int64), np.ones(len(ids) - self.n + 1, bool)
        for k in range(self.n):
            part = ids[k : len(ids) - self.n + 1 + k]
            known &= part >= 0
            out = out * self.base + part
        return np.where(known, out, -1)

    def find(self, keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose key is among sorted ``grams``, and the index there."""
        at = np.flatnonzero(keys >= 0)
        if not len(at) or not len(grams):
            return at[:0], at[:0]
        slot = np.minimum(np.searchsorted(grams, keys[at]), len(grams) - 1)
        hit = grams[slot] == keys[at]
        return at[hit], slot[hit]

    def seeds(self, seen: np.ndarray, stretch: int = 4) -> dict[int, list[tuple[int, int]]]:
        """Gram index -> [(item index, place)] of the rarest n-gram of every stretch of an item."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i, keys in enumerate(self.places):
            slot = np.searchsorted(self.grams, keys)
            rank = list(zip(seen[slot].tolist(), keys.tolist(), range(len(keys)), strict=True))
            picked = {min(rank[k : k + stretch])[2] for k in range(max(1, len(rank) - stretch + 1))}
            for p in sorted(picked):
                out.setdefault(int(slot[p]), []).append((i, p))
        return out


class WordIds(dict):
    """Raw word -> id among the items' words, or -1; bounded by clearing."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        p = plain(word)
        found = self[word] = self.vocab.get(p, -1) if p else -2
        return found

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text's words without bare marks, and where each stands among all words."""
        words = (text or "").split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(ids != -2)
        return ids[at], at


def align_many(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Best local alignment scores of item-region pairs, one row of every dynamic programme at a time.

    With linear gap costs a row's horizontal gaps are a running maximum of score + cost x column.
    """
    if not items:
        return np.zeros(0, np.int64)
    rows, cols = max(map(len, items)), max(map(len, regions))
    a = np.full((len(items), rows), -3, np.int64)
    b = np.full((len(items), cols), -4, np.int64)
    for k, (x, y) in enumerate(zip(items, regions, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    slope = np.arange(cols) * -GAP
    h, best = np.zeros((len(items), cols), np.int64), np.zeros(len(items), np.int64)
    for i in range(rows):
        h = _row(h, b == a[:, i : i + 1], slope)
        best = np.maximum(best, h.max(axis=1))
    return best


def _row(h: np.ndarray, same: np.ndarray, slope: np.ndarray) -> np.ndarray:
    diagonal = np.zeros_like(h)
    diagonal[:, 1:] = h[:, :-1]
    start = np.maximum(np.maximum(diagonal + np.where(same, MATCH, MISMATCH), h + GAP), 0)
    return np.maximum.accumulate(start + slope, axis=1) - slope


def trace(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int, int]:
    """(score, first column, last column, matched words) of the best local alignment; of equals, the first to end."""
    slope, h = np.arange(len(region)) * -GAP, np.zeros((1, len(region)), np.int64)
    table = []
    for w in item:
        h = _row(h, (region == w)[None, :], slope)
        table.append(h[0].tolist())
    score = max(map(max, table))
    i = next(k for k, r in enumerate(table) if max(r) == score)
    j = last = table[i].index(score)
    matched, first = 0, j
    while i >= 0 and j >= 0 and table[i][j] > 0:
        first = j
        here = table[i][j]
        before = table[i - 1][j - 1] if i and j else 0
        same = item[i] == region[j]
        if here == before + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif i and here == table[i - 1][j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, first, last, matched


class Scanner:
    def __init__(self, items: Items, seen: np.ndarray):
        self.items, self.known = items, WordIds(items.vocab)
        chosen = items.seeds(seen)
        self.slots = np.array(sorted(chosen), np.int64)
        self.grams = items.grams[self.slots] if len(self.slots) else np.zeros(0, np.int64)
        self.at = [chosen[int(s)] for s in self.slots]

    def regions(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item index, from, to) of regions of a document that seeds point to."""
        where, slot = self.items.find(self.items.keys(ids), self.grams)
        starts: dict[int, list[int]] = {}
        for p, s in zip(where.tolist(), slot.tolist(), strict=True):
            for item, place in self.at[s]:
                starts.setdefault(item, []).append(p - place)
        out = []
        for item, begin in starts.items():
            size = len(self.items.words[item])
            pad = size // 3 + 4
            begin.sort()
            lo = hi = begin[0]
            for b in [*begin[1:], None]:
                if b is not None and b - hi <= pad:
                    hi = b
                    continue
                out.append((item, max(0, lo - pad), min(len(ids), hi + size + pad)))
                if b is not None:
                    lo = hi = b
        return out

    def scan(self, texts: list[str | None], threshold: float) -> list[list[tuple[int, float, int, int, int]]]:
        """For each text, (item id, share of the best score, first word, last word, matched words) of items it holds."""
        docs, jobs = [], []
        for k, t in enumerate(texts):
            ids, at = self.known.ids(t)
            docs.append((ids, at))
            jobs += [(k, *r) for r in self.regions(ids)]
        jobs.sort(key=lambda j: len(self.items.words[j[1]]))
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for k in range(0, len(jobs), 256):
            part = jobs[k : k + 256]
            scores = align_many([self.items.words[i] for _, i, _, _ in part], [docs[d][0][x:y] for d, _, x, y in part])
            for (d, i, x, y), s in zip(part, scores.tolist(), strict=True):
                share = s / (MATCH * len(self.items.words[i]))
                if share >= threshold and (i not in best[d] or (-share, x) < best[d][i][:2]):
                    best[d][i] = (-share, x, y)
        out = []
        for d, found in enumerate(best):
            rows = []
            for i, (_, x, y) in sorted(found.items()):
                s, first, last, matched = trace(self.items.words[i], docs[d][0][x:y])
                at = docs[d][1]
                rows.append((self.items.ids[i], s / (MATCH * len(self.items.words[i])), int(at[x + first]), int(at[x + last]), matched))
            out.append(rows)
        return out


def item_slices(benchmark: DataFrame, item_col: str, text_col: str, slice_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Test items in slices of bounded size, each fetched by itself."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    n = max(1, -(-(total[0] or 0) // slice_chars))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield sorted((r.item, r.text) for r in part.collect())


def scanners(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, slice_chars: int = 8_000_000) -> Iterator[tuple[list[tuple[int, str]], np.ndarray]]:
    """(items, n-gram counts over all documents) of each slice; counts are of documents that hold the n-gram."""
    spark = docs.sparkSession
    runtime.ship(spark)
    for part in item_slices(benchmark, item_col, item_text_col, slice_chars):
        items = Items(part, n)
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, n)
            known, count = WordIds(items.vocab), np.zeros(len(items.grams), np.int64)
            for b in batches:
                for t in b.column(0):
                    _, slot = items.find(items.keys(known.ids(t.as_py())[0]), items.grams)
                    count[np.unique(slot)] += 1
            at = np.flatnonzero(count)
            yield pa.record_batch([pa.array(at), pa.array(count[at])], names=["slot", "n"])

        got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        seen = np.zeros(len(items.grams), np.int64)
        seen[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        yield part, seen


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, matched_words) of every document and item that align well enough."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, first_word long, last_word long, matched_words long"
    out = None
    for part, seen in scanners(docs, benchmark, text_col, **how):
        shared = spark.sparkContext.broadcast((part, seen))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part, seen = shared.value
            s = Scanner(Items(part, how.get("n", 3)), seen)
            for b in batches:
                for k in range(0, b.num_rows, 1024):
                    piece = b.slice(k, 1024)
                    found = s.scan(piece.column(1).to_pylist(), threshold)
                    at = [i for i, rows in enumerate(found) for _ in rows]
                    flat = [r for rows in found for r in rows]
                    cols = [pa.array([r[c] for r in flat], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
                    yield pa.record_batch([piece.column(0).take(pa.array(at, pa.int64())), *cols], names=["doc_id", "item_id", "score", "first_word", "last_word", "matched_words"])

        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` that hold no test item, with all of their columns."""
    spark, width = docs.sparkSession, len(docs.columns)
    out = docs
    for part, seen in scanners(docs, benchmark, text_col, **how):
        shared = spark.sparkContext.broadcast((part, seen))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part, seen = shared.value
            s = Scanner(Items(part, how.get("n", 3)), seen)
            for b in batches:
                for k in range(0, b.num_rows, 1024):
                    piece = b.slice(k, 1024)
                    good = [not rows for rows in s.scan(piece.column(width).to_pylist(), threshold)]
                    yield piece.select(list(range(width))).filter(pa.array(good, pa.bool_()))

        out = out.select("*", F.col(text_col).cast("string").alias("__text")).mapInArrow(run, docs.schema)
    return out
