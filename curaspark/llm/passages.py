"""Substring dedup by paragraph MinHash banding (operator 8).

Paragraphs are the lines of a text, of every length. Each has a set of five-word shingles (the line itself where it is
shorter), a MinHash signature over it, and bands of the signature as join keys, as many as ``bands_for`` needs for the recall
asked. Paragraphs that collide are verified by exact Jaccard similarity, and components of verified links are classes. Two
unequal sets reach a similarity of 0.8 only if one of them has four shingles and the other five at least, which takes a line
of eight words; below that a class is the paragraph's own hash and needs no band.

The word stream is also cut into short paragraphs at places its own words choose - where the hash of two adjacent words is
least among its neighbours - so a passage inside differing lines falls into the same short paragraphs wherever it stands, but
for its ends. These are matched by the hash of their words. Each sequence of ``min_words`` words around those that repeat is
then looked up in other documents, so passages are found to their true ends, word by word, and runs of repeated short
paragraphs with small gaps are joined and banded and verified as lines are.

A passage is what shared sequences and repeated paragraphs of ``min_words`` words or more cover without a gap. ``min_words`` is
51: passages of over 50 words are what this operator removes; paragraphs of any length are classed by ``paragraphs``.

Cases: null, empty or blank texts hold no paragraph; rows that share an id, also a null one, count as one document;
repeated rows report their passages once each; case and marks at the edges of words don't matter; very long texts and lines
are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import buckets, runtime

_staged = functools.partial(runtime.staged, tidy=True)
NO_ID = (1 << 63) - 1
BROADCAST_BYTES = 16 << 20
EDGES = b".,;:!?\"'()[]{}<>*$#%&|_-"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _byte_codes() -> np.ndarray:
    codes = np.random.default_rng(12).integers(1, 1 << 64, 256, dtype=np.uint64)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


CODES = _byte_codes()
SPACE, EDGE = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", EDGES))


_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, kept and grown as longer texts come."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 15)
        rows = []
        for x in (BASE, INVERSE):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            rows.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = rows
    return _powers[0], _powers[1]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every range, n of them each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _byte_hashes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Hashes of the words raw[lo:hi], case apart: differences of polynomial prefix sums, over about ``most`` bytes at a time."""
    out = np.empty(len(lo), np.uint64)
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + most)))
        a, b = lo[i:j] - lo[i], hi[i:j] - lo[i]
        n = int(b[-1])
        power, back = _powers_to(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[raw[lo[i] : lo[i] + n]] * power[:n], dtype=np.uint64, out=prefix[1:])
        out[i:j] = _mix((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64))
        i = j
    return out


def word_stream(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, docs, lines) of texts that lie in a row in ``raw`` from bounds[i] to bounds[i + 1].

    h has a 64-bit hash of each word, lower-cased and without marks at its edges; the words of text i are docs[i] to docs[i + 1],
    and a line with a word begins at every place in ``lines``, which ends with the number of words.
    """
    space = SPACE[raw]
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    some = np.diff(bounds) > 0
    before[bounds[:-1][some]] = True
    after[bounds[1:][some] - 1] = True
    lo, hi = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    docs = np.searchsorted(lo, bounds)
    begins = np.zeros(len(lo) + 1, bool)
    begins[docs] = True
    begins[np.searchsorted(lo, np.flatnonzero(raw == 10))] = True
    begins[-1] = True
    if len(lo):
        # words lose the marks at their edges, but words of marks alone
        edge = EDGE[raw]
        kept = np.append(np.flatnonzero(~edge), len(raw))
        first, last = lo.copy(), hi.copy()
        at = np.flatnonzero(edge[lo])
        first[at] = kept[np.searchsorted(kept, lo[at])]
        marks = first >= hi
        first[marks] = lo[marks]
        at = np.flatnonzero(edge[hi - 1] & ~marks)
        last[at] = kept[np.searchsorted(kept, hi[at]) - 1] + 1
        h = _byte_hashes(raw, first, last)
    else:
        h = np.zeros(0, np.uint64)
    return h, docs, np.flatnonzero(begins)


def word_hashes(text: bytes | None) -> tuple[np.ndarray, list[int]]:
    """Hashes of a text's words, and where its lines with a word end."""
    raw = np.frombuffer(text or b"", np.uint8)
    with np.errstate(over="ignore"):
        h, _, lines = word_stream(raw, np.array([0, len(raw)]))
    return h, lines[1:].tolist()


def parts(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches with the word streams of a column of texts: at most so many rows, of about so many bytes."""
    for b in batches:
        texts = b.column(column)
        sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
        past = np.cumsum(sizes)
        k = 0
        while k < b.num_rows:
            end = min(k + rows, max(k + 1, int(np.searchsorted(past, past[k] - sizes[k] + most))), b.num_rows)
            raw = np.frombuffer(b"".join(x.as_buffer() for x in texts.slice(k, end - k) if x.is_valid), np.uint8)
            with np.errstate(over="ignore"):
                stream = word_stream(raw, np.concatenate([[0], np.cumsum(sizes[k:end])]))
            yield b.slice(k, end - k), *stream
            k = end


def own_cuts(h: np.ndarray, docs: np.ndarray, reach: int = 4) -> np.ndarray:
    """Where short paragraphs begin by choice of the words: the pair of words there hashes below all pairs within ``reach`` on either side."""
    if len(h) < 2 * reach + 2:
        return np.zeros(0, np.int64)
    g = _mix(h[:-1] * BASE + h[1:])
    keep = np.ones(len(g) - 2 * reach, bool)
    mid = g[reach : len(g) - reach]
    for k in range(1, reach + 1):
        keep &= mid < g[reach - k : len(g) - reach - k]
        keep &= mid < g[reach + k : len(g) - reach + k]
    own = np.flatnonzero(keep) + reach
    # all pairs looked at must be of one text
    text = np.searchsorted(docs, own, "right") - 1
    return own[(own - docs[text] >= reach) & (docs[text + 1] - own >= reach + 2)]


def cuts(h: np.ndarray, docs: np.ndarray | None = None, own: np.ndarray | None = None, most: int = 24) -> np.ndarray:
    """Where short paragraphs begin, and the end: at a text's begin and at its ``own_cuts``.

    A stretch of over ``most`` words without such a place, as one word said over and over is, is cut every ``most`` / 2 words.
    """
    docs = np.array([0, len(h)]) if docs is None else docs
    at = np.union1d(docs, own_cuts(h, docs) if own is None else own)
    if not most:
        return at
    long = np.flatnonzero(np.diff(at) > most)
    n = -(-(at[long + 1] - at[long]) // (most // 2))
    more = np.repeat(at[long], n) + _ranges(np.zeros(len(long), np.int64), n) * (most // 2)
    return np.union1d(at, more)


def span_keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences from starts to ends: differences of a polynomial prefix sum, shifted back."""
    n = len(h)
    power, back = _powers_to(n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h) * power[:n], dtype=np.uint64)])
    return _mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct 32-bit hashes of the shingles of a word sequence, sorted."""
    n = max(1, len(h) - size + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        s = _mix(s * BASE + h[k : k + n])
    return np.unique((s >> np.uint64(32)).astype(np.uint32))


def bands_for(rows: int, similarity: float, recall: float) -> int:
    """Bands of ``rows`` minima each that let a pair of the given similarity meet with at least the given probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


@functools.cache
def _permutations(n: int, seed: int) -> list[tuple[np.uint32, np.uint32]]:
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)
    return list(zip(a, b, strict=True))


def bands_of(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """MinHash bands of many shingle sets at once, as a matrix of signed longs: sets lie in a row and begin at ``starts``.

    Shingles may repeat inside a set, as a minimum doesn't see it.
    """
    key = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(starts), axis=0)
    for k, (a, b) in enumerate(_permutations(bands * rows, seed)):
        least = np.minimum.reduceat(grams * a + b, starts)
        key[:, k % bands] = _mix(key[:, k % bands] * BASE + least)
    return key.view(np.int64)


def band_keys(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash bands of one shingle set."""
    with np.errstate(over="ignore"):
        return bands_of(grams.astype(np.uint32), np.zeros(1, np.int64), bands, rows)[0]


def rolling_grams(h: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of the ``size`` words from every place on; the same as ``shingle_hashes`` before it sorts."""
    s = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        s = _mix(s * BASE + h[k : k + len(s)])
    return (s >> np.uint64(32)).astype(np.uint32)


def line_bands(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, shingle: int, bands: int, rows: int) -> np.ndarray:
    """Bands of the lines of a word stream, each of at least ``shingle`` words."""
    if not len(starts):
        return np.zeros((0, bands), np.int64)
    n = stops - starts - shingle + 1
    return bands_of(rolling_grams(h, shingle)[_ranges(starts, n)], np.cumsum(n) - n, bands, rows)


def shingle_sets(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, shingle: int) -> list[bytes]:
    """Distinct shingles, sorted, of parts of a word stream, each of at least ``shingle`` words."""
    n = stops - starts - shingle + 1
    grams = rolling_grams(h, shingle)[_ranges(starts, n)].astype(np.uint64)
    keyed = np.unique(grams | np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32))
    ends = np.searchsorted(keyed, np.arange(1, len(n) + 1, dtype=np.uint64) << np.uint64(32))
    return [x.tobytes() for x in np.split((keyed & np.uint64(0xFFFFFFFF)).astype("<u4"), ends[:-1])] if len(n) else []


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, d, text) of every row."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(d, text).alias("uid"), d.alias("d"), text.cast("binary").alias("text"))


def banded_from(similarity: float, shingle: int) -> int:
    """Words from which two unequal paragraphs can reach the similarity: k of k + 1 shingles shared, k / (k + 1) being enough."""
    return math.ceil(similarity / (1 - similarity) - 1e-9) + shingle - 1


def units(docs: DataFrame, id_col: str, text_col: str, min_words: int, similarity: float, shingle: int, bands: int, rows: int, cut: bool = True) -> DataFrame:
    """Paragraphs of every row: (uid, d, is_line, start, n, key, chain, reach, bands); lines only unless ``cut``.

    A short paragraph's chain is the hash of the ``reach`` words from its start to the first cut that is min_words or more
    after the next paragraph's start, or to the end: all sequences of min_words words that begin in the paragraph. Lines too
    short to resemble an unequal one have no bands.
    """
    runtime.ship(docs.sparkSession)
    least = banded_from(similarity, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, docs, edges in parts(batches, 2):
            if not len(h):
                continue
            with np.errstate(over="ignore"):
                at, first, ends = cuts(h, docs), edges[:-1], edges[1:]
                good = (np.diff(at) >= 4) & cut
                starts, stops = np.concatenate([at[:-1][good], first]), np.concatenate([at[1:][good], ends])
                is_line = np.arange(len(starts)) >= len(starts) - len(first)
                text = np.searchsorted(docs, starts, "right") - 1
                last = np.minimum(at[np.minimum(np.searchsorted(at, stops + min_words), len(at) - 1)], docs[text + 1])
                last[is_line] = stops[is_line]
                keys, chains = span_keys(h, np.concatenate([starts, starts]), np.concatenate([stops, last])).view(np.int64).reshape(2, -1)
                long = ends - first >= least
                # bands of all lines of the part at once
                found = line_bands(h, first[long], ends[long], shingle, bands, rows)
            size = np.zeros(len(starts), np.int32)
            size[len(starts) - len(first) :][long] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(found.reshape(-1)))
            flat = (is_line, (starts - docs[text]).astype(np.int32), (stops - starts).astype(np.int32), keys, chains, (last - starts).astype(np.int32))
            yield pa.record_batch([*(part.column(i).take(pa.array(text)) for i in (0, 1)), *map(pa.array, flat), lists], names=["uid", "d", "is_line", "start", "n", "key", "chain", "reach", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "uid long, d long, is_line boolean, start int, n int, key long, chain long, reach int, bands array<long>")


def _hint(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """A table broadcast where its count shows it small; past that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def line_shingles(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, met: DataFrame, shingle: int) -> DataFrame:
    """(key, grams): the shingles of the lines (uid, start, n, key) whose key is among ``met``, made again from their texts.

    Each key is read from one row, the least, so copies are read once and most texts not at all.
    """
    runtime.ship(docs.sparkSession)
    one = lines.join(_hint(met, 16), "key", "left_semi").groupBy("key").agg(F.min(F.struct("uid", "start", "n")).alias("x"))
    held = _staged(one.groupBy("x.uid").agg(F.collect_list(F.struct("x.start", "x.n", "key")).alias("lines"), F.count(F.lit(1)).alias("size")), "line-rows")
    small = (held.agg(F.sum("size")).first()[0] or 0) * 16 + held.count() * 32 <= BROADCAST_BYTES
    held = F.broadcast(held) if small else held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, docs, _ in parts(batches, 0):
            mine, text = part.column(1).flatten(), pc.list_parent_indices(part.column(1)).to_numpy()
            starts, n, key = (mine.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            starts = starts + docs[text]
            if len(key):
                with np.errstate(over="ignore"):
                    yield pa.record_batch([pa.array(key), pa.array(shingle_sets(h, starts, starts + n, shingle), pa.binary())], names=["key", "grams"])

    rows = _texts(docs, id_col, text_col).join(held, "uid").select("text", "lines")
    return rows.mapInArrow(read, "key long, grams binary").dropDuplicates(["key"])


def open_windows(h: np.ndarray, docs: np.ndarray, starts: np.ndarray, stops: np.ndarray, told: np.ndarray, size: int) -> np.ndarray:
    """Where sequences of ``size`` words around repeated paragraphs begin, without those inside a chain that another row tells.

    A text shared with another document can reach beyond its whole paragraphs into the next one on either side, and past that
    one's cut by as many words as a cut looks at: four before it, six after. Cuts are those that words choose, as the others
    may lie elsewhere in the other document. A sequence that holds all words that choose two cuts in a row has the same short
    paragraphs between them wherever it stands, so one of them that doesn't repeat keeps it from being shared.
    """
    n, own = len(h), own_cuts(h, docs)
    at, every = cuts(h, docs, own, most=0), cuts(h, docs, own)
    text = np.searchsorted(docs, starts, "right") - 1
    lo = np.maximum(at[np.maximum(np.searchsorted(at, starts) - 1, 0)] - 4, docs[text])
    hi = np.minimum(at[np.minimum(np.searchsorted(at, stops, "right"), len(at) - 1)] + 6, docs[text + 1])
    inside = _covered(n, lo, hi)
    # a window's words are all inside: as many as its size since it began
    full = np.concatenate([[0], np.cumsum(inside)])
    ok = np.zeros(n, bool)
    if n >= size:
        ok[: n - size + 1] = full[size:] - full[:-size] == size
    # stretches between two own cuts that hold a paragraph which doesn't repeat
    repeats, mine = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    repeats[starts] = mine[own] = True
    begins = every[:-1][np.diff(every) >= 4]
    alone = np.unique(np.searchsorted(at, begins[~repeats[begins]], "right") - 1)
    alone = alone[mine[at[alone]] & mine[at[alone + 1]]]
    barred = np.maximum(at[alone + 1] + 6 - size, docs[np.searchsorted(docs, at[alone], "right") - 1])
    # and windows that end in the next text
    first = np.concatenate([starts[told], barred, np.maximum(docs[1:] - size + 1, docs[:-1])])
    past = np.concatenate([np.minimum(stops[told] + 1, docs[text + 1][told]), at[alone] - 3, docs[1:]])
    return np.flatnonzero(ok & ~_covered(n, first, past))


def _covered(n: int, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    good = first < past
    return np.cumsum(np.bincount(first[good], minlength=n + 1)[:n] - np.bincount(past[good], minlength=n + 1)[:n]) > 0


def joined_spans(starts: np.ndarray, stops: np.ndarray, gap: int, least: int, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of repeated paragraphs of one text joined over gaps of at most ``gap`` words, where there is a gap and ``least`` words are reached."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(stops[order])
    text = np.zeros(len(starts), np.int64) if text is None else text[order]
    new = np.concatenate([[True], (starts[1:] > far[:-1] + gap) | (text[1:] != text[:-1])])
    open_ = np.concatenate([[False], starts[1:] > far[:-1]]) & ~new
    first = np.flatnonzero(new)
    lo, hi = starts[first], far[np.append(first[1:], len(starts)) - 1]
    good = np.logical_or.reduceat(open_, first) & (hi - lo >= least)
    return lo[good], hi[good]


def windows(texts: DataFrame, size: int, shingle: int, bands: int, rows: int, gap: int = 24) -> DataFrame:
    """Open windows and joined spans, these with bands, of (uid, d, text, near), near being a row's repeated paragraphs.

    (uid, d, start, n, key, bands, grams); bands and grams are null for windows.
    """
    names = ["uid", "d", "start", "n", "key", "bands", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, docs, _ in parts(batches, 2):
            near, text = part.column(3).flatten(), pc.list_parent_indices(part.column(3)).to_numpy()
            starts, n, told = (near.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = starts.astype(np.int64) + docs[text]
            stops = starts + n

            def flat(first: np.ndarray, end: np.ndarray, part=part, h=h, docs=docs) -> list[pa.Array]:
                text = np.searchsorted(docs, first, "right") - 1
                with np.errstate(over="ignore"):
                    keys = span_keys(h, first, end).view(np.int64)
                return [*(part.column(i).take(pa.array(text)) for i in (0, 1)), *map(pa.array, ((first - docs[text]).astype(np.int32), (end - first).astype(np.int32), keys))]

            with np.errstate(over="ignore"):
                at = open_windows(h, docs, starts, stops, told.astype(bool), size)
                lo, hi = joined_spans(starts, stops, gap, size, text)
                found, sets = line_bands(h, lo, hi, shingle, bands, rows), shingle_sets(h, lo, hi, shingle)
            if len(at):
                yield pa.record_batch([*flat(at, at + size), pa.nulls(len(at), pa.list_(pa.int64())), pa.nulls(len(at), pa.binary())], names=names)
            if len(lo):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1) * bands, pa.int32()), pa.array(found.reshape(-1)))
                yield pa.record_batch([*flat(lo, hi), lists, pa.array(sets, pa.binary())], names=names)

    return texts.mapInArrow(run, "uid long, d long, start int, n int, key long, bands array<long>, grams binary")


def _across(rows: DataFrame, key: str) -> DataFrame:
    """Keys that rows of different documents have, with the least of those documents."""
    return rows.groupBy(key).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select(key, "lo")


def cluster(grams: list[np.ndarray], similarity: float) -> np.ndarray:
    """Component (least index) of every set under Jaccard >= similarity, each exactly verified.

    A search from set to set: a set is compared with those not reached yet only, so groups of near copies take few passes.
    """
    sizes = np.array([len(g) for g in grams])
    if len(grams) <= 64 and int(sizes.sum()) * len(grams) <= 1 << 20:
        return _cluster_few(grams, sizes, similarity)
    lab = np.full(len(grams), -1)
    todo = np.argsort(sizes, kind="stable")
    while len(todo):
        root, queue = int(todo[0]), [int(todo[0])]
        lab[root] = root
        todo = todo[1:]
        members = [root]
        while queue and len(todo):
            x = queue.pop()
            near = todo[(sizes[todo] >= similarity * sizes[x]) & (sizes[x] >= similarity * sizes[todo])]
            if not len(near):
                continue
            flat = np.concatenate([grams[i] for i in near])
            slot = np.minimum(np.searchsorted(grams[x], flat), sizes[x] - 1)
            shared = np.add.reduceat((grams[x][slot] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            linked = near[shared >= similarity * (sizes[near] + sizes[x] - shared) - 1e-9]
            lab[linked] = root
            members += linked.tolist()
            queue += linked.tolist()
            todo = todo[~np.isin(todo, linked)]
        lab[members] = min(members)
    return lab


def _cluster_few(grams: list[np.ndarray], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """``cluster`` by one table of sets and shingles."""
    every, slot = np.unique(np.concatenate(grams), return_inverse=True)
    has = np.zeros((len(grams), len(every)), np.float32)
    has[np.repeat(np.arange(len(grams)), sizes), slot] = 1
    shared = (has @ has.T).astype(np.int64)
    linked = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    lab = np.arange(len(grams))
    while True:
        least = np.where(linked, lab[None, :], len(grams)).min(axis=1)
        if (least == lab).all():
            return lab
        lab = least


def _line_edges(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: dict[int, np.ndarray]):
            if len(rows) < 2:
                return None
            keys = sorted(rows)
            lab = cluster([rows[k] for k in keys], similarity)
            far = [i for i in range(len(keys)) if lab[i] != i]
            return pa.record_batch([pa.array([keys[i] for i in far], pa.int64()), pa.array([keys[lab[i]] for i in far], pa.int64())], names=["a", "b"]) if far else None

        last, rows = None, {}
        for b in batches:
            for band, x, y, key, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                if (band, x, y) != last:
                    out = flush(rows)
                    if out is not None:
                        yield out
                    last, rows = (band, x, y), {}
                rows[key] = np.frombuffer(grams.as_buffer(), "<u4")
        out = flush(rows)
        if out is not None:
            yield out

    return run


def _pair_edges(similarity: float):
    """Pairs (a, b, ga, gb) to those whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                least, most = min(len(x), len(y)), max(len(x), len(y))
                shared = 0
                if least >= similarity * most:
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                good.append(shared >= similarity * (least + most - shared) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _classed(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, spans: DataFrame | None, similarity: float, shingle: int, cap: int) -> DataFrame:
    """(uid, d, start, n, component_id) of lines (uid, d, start, n, key, bands) and spans (the same, with grams).

    Most bands that are shared at all are shared by two paragraphs: such pairs are verified once, however many bands they
    share; bands of more members are dealt in blocks, once for all bands of the same members.
    """
    spark = docs.sparkSession
    cols = ["uid", "d", "start", "n", "key"]
    every = lines.select(*cols, "bands") if spans is None else lines.select(*cols, "bands").unionByName(spans.select(*cols, "bands"))
    banded = every.where(F.size("bands") > 0).select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("band")
    members = _staged(banded.join(_staged(shared, "bands-shared"), "band").distinct(), "band-members")
    told = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.expr("bit_xor(xxhash64(key))").alias("x"), F.expr("bit_xor(xxhash64(key, 7))").alias("y"))
    # bands of the same paragraphs are one
    told = _staged(told.groupBy("n", "a", "b", "x", "y").agg(F.min("band").alias("band")), "bands-told")
    pairs = _staged(told.where("n = 2").select("a", "b"), "line-pairs")
    many = members.join(_hint(told.where("n > 2").select("band"), 16), "band")
    dealt = _staged(buckets.block_pairs(many, "band", "key", cap), "line-buckets")
    met = _staged(dealt.select("key").unionByName(pairs.select(F.col("a").alias("key"))).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "lines-met")
    grams = line_shingles(docs, id_col, text_col, lines, met, shingle)
    if spans is not None:
        grams = grams.unionByName(spans.select("key", "grams").join(_hint(met, 16), "key", "left_semi")).dropDuplicates(["key"])
    payload = _staged(grams, "line-shingles")
    two = pairs.join(payload.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(payload.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    edges = two.select("a", "b", "ga", "gb").mapInArrow(_pair_edges(similarity), "a long, b long")
    sets = dealt.join(payload, "key").select("band", "blk_a", "blk_b", "key", "grams")
    n = runtime.partitions(spark)
    edges = edges.unionByName(sets.repartition(n, "band", "blk_a", "blk_b").sortWithinPartitions("band", "blk_a", "blk_b").mapInArrow(_line_edges(similarity), "a long, b long"))
    comp = runtime.cut(buckets.components(edges).where("node != component").select(F.col("node").alias("key"), "component"))
    return every.select(*cols).join(comp, "key", "left").select("uid", "d", "start", "n", F.coalesce("component", "key").alias("component_id"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.99, shingle: int = 5, rows: int = 3, cap: int = 1024) -> DataFrame:
    """doc_id, first_word, n_words, component_id of every line with a word: lines of one class are linked by similarity."""
    found = _staged(units(docs, id_col, text_col, 1, similarity, shingle, bands_for(rows, similarity, recall), rows, cut=False), "lines")
    return _classed(docs, id_col, text_col, found, None, similarity, shingle, cap).select(F.expr(f"nullif(d, {NO_ID}L)").alias("doc_id"), F.col("start").alias("first_word"), F.col("n").alias("n_words"), "component_id")


def repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.99, min_words: int = 51, shingle: int = 5, rows: int = 3, cap: int = 1024
) -> DataFrame:
    """One row for each paragraph that repeats across documents inside a passage of at least ``min_words`` words.

    doc_id, first_word and n_words place the paragraph; component_id is its class, first_doc_id the smallest id that has the
    class; removed is true where the paragraph is a copy of one in an earlier document; passage_first_word and
    passage_n_words place the passage it belongs to. A document none of whose passages repeats has no row.
    """
    bands = bands_for(rows, similarity, recall)
    start = runtime.mark()
    found = _staged(units(docs, id_col, text_col, min_words, similarity, shingle, bands, rows), "paragraphs")
    short = found.where("not is_line").select("uid", "d", "start", "n", "key", "chain", "reach")
    spark = docs.sparkSession
    classes = _staged(_across(short, "key"), "short-classes")
    near = _staged(short.join(classes, "key").withColumnRenamed("key", "component_id"), "shorts")
    runtime.drop_named(spark, start, "short-classes")
    shorts = near.select("uid", "d", "start", "n", "component_id", "lo")

    # sequences of min_words words around repeated paragraphs: a chain that repeats as it is tells of all of its own, and its
    # least document alone opens them, for texts that share less than the chain; all others are opened one by one
    chains = _staged(_across(near, "chain").withColumnRenamed("lo", "teller"), "chains")
    near = near.join(chains, "chain", "left").select("uid", "start", "n", "reach", F.col("teller").isNotNull().alias("known"), F.coalesce(F.col("teller") != F.col("d"), F.lit(False)).alias("told"))
    near = _staged(near, "shorts-chained")
    runtime.drop_named(spark, start, "chains")
    held = near.groupBy("uid").agg(F.collect_set(F.struct("start", "n", "told")).alias("near")).where(F.exists("near", lambda x: ~x["told"]))
    opened = _staged(windows(_texts(docs, id_col, text_col).join(held, "uid").select("uid", "d", "text", "near"), min_words, shingle, bands, rows), "windows")
    spans, opened = _staged(opened.where("bands is not null"), "spans"), opened.where("bands is null")
    again = _staged(_across(opened, "key").select("key"), "windows-shared")
    shared = _staged(opened.join(again, "key").select("uid", F.col("start").alias("first"), (F.col("start") + min_words).alias("end")), "windows-met")
    runtime.drop_named(spark, start, "windows", "windows-shared")
    shared = shared.unionByName(near.where(F.col("known") & (F.col("reach") >= min_words)).select("uid", F.col("start").alias("first"), (F.col("start") + F.col("reach")).alias("end")))

    point = runtime.mark()
    classed = _staged(_classed(docs, id_col, text_col, found.where("is_line"), spans, similarity, shingle, cap), "lines-classed")
    runtime.drop_since(spark, point)
    runtime.drop_named(spark, start, "paragraphs", "spans")
    spans = runtime.cut(classed.groupBy("component_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("component_id", "lo"))
    longs = classed.join(spans, "component_id").select("uid", "d", "start", "n", "component_id", "lo")

    # passages: what shared sequences and repeated lines cover without a gap, within a row's own words only
    every = shorts.unionByName(longs).withColumn("stop", F.col("start") + F.col("n"))
    shared = shared.unionByName(longs.where(F.col("n") >= min_words).select("uid", F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("end"))).distinct()
    order = Window.partitionBy("uid").orderBy("first", "end")
    fresh = F.when(F.col("first") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    runs = shared.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("uid", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    runs = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "end")).alias("passages"))
    within = F.filter("passages", lambda p: (p["first"] <= F.col("start")) & (p["end"] >= F.col("stop")))
    placed = every.join(runs, "uid").withColumn("p", F.get(within, F.lit(0))).where("p is not null")
    name = lambda c: F.expr(f"nullif({c}, {NO_ID}L)")
    return placed.select(
        name("d").alias("doc_id"), F.col("start").alias("first_word"), F.col("n").alias("n_words"), "component_id", name("lo").alias("first_doc_id"), (F.col("d") != F.col("lo")).alias("removed"),
        F.col("p.first").alias("passage_first_word"), (F.col("p.end") - F.col("p.first")).alias("passage_n_words"),
    )
