"""SimHash near-duplicates with bit-sliced comparison (operator 7).

Fingerprints are computed per whole text; equal fingerprints collapse to one node before anything is compared. Pairs within
the radius share at least ``blocks - radius`` of ``blocks`` bit blocks, so they meet in a bucket keyed by that many blocks;
inside a bucket all distances are counted at once on vertical bit planes with carry-save counters.

Cases: a null or blank text has fingerprint 0 and links like any other; a null id is kept, counts as larger than every id,
and its component_id is null only if no id of the group is known; repeated rows keep one output row each; an empty table
gives an empty result; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, runtime

NO_ID = (1 << 63) - 1
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, ngram: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included, as an unsigned int."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - ngram + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, seed)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    s, e = starts[:n].tolist(), ends[ngram - 1 :].tolist()
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(s[k : k + (1 << 15)], e[k : k + (1 << 15)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row j holds bit j of every fingerprint, packed in 64-bit words."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, fps: np.ndarray, radius: int = 3, words: int = 1 << 16) -> np.ndarray:
    """Boolean matrix (query, fingerprint) of Hamming distance <= radius, radius at most 7.

    Distances of 64 fingerprints advance with each 64-bit operation: planes enter in pairs through a carry-save adder and
    ripple through vertical counter bits; a lane whose counter passes the radius is dead, and a block of lanes is
    abandoned as soon as all of its lanes are dead.
    """
    out = np.zeros((len(queries), len(fps)), bool)
    vert = planes(fps)
    level = max(1, (radius + 1).bit_length() - ((radius + 1) & radius == 0))  # counter bits below the overflow bit
    mask = (np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64)) * np.uint64(0xFFFFFFFFFFFFFFFF)
    per = max(1, words // max(1, vert.shape[1]))
    for k in range(0, len(queries), per):
        q = mask[k : k + per]
        shape = (len(q), vert.shape[1])
        count = [np.zeros(shape, np.uint64) for _ in range(level)]
        dead = np.zeros(shape, np.uint64)
        for j in range(0, 64, 2):
            x, y = vert[j][None, :] ^ q[:, j : j + 1], vert[j + 1][None, :] ^ q[:, j + 1 : j + 2]
            half = count[0] ^ x
            carry = (count[0] & x) | (half & y)
            count[0] = half ^ y
            for i in range(1, level):
                carry, count[i] = carry & count[i], carry ^ count[i]
            dead |= carry
            if j % 16 == 14 and not (~dead).any():
                break
        else:
            live = np.unpackbits((~dead).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(bool)
            if radius + 1 != 1 << level:  # counters hold more than the radius: compare the exact count
                exact = sum(np.unpackbits(c.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(np.int64) << i for i, c in enumerate(count))
                live &= exact <= radius
            out[k : k + len(q)] = live
    return out


def star_edges(fps: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a boolean matrix as edges to the smallest index of each local component."""
    lab = np.arange(len(fps))
    while True:
        new = np.minimum(lab, np.where(linked, lab[None, :], len(fps)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == lab).all():
            break
        lab = new
    far = np.flatnonzero(lab != np.arange(len(fps)))
    return fps[far], fps[lab[far]]


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fp, chunk, a, b):
            u, first = np.unique(fp, return_index=True)
            if len(u) < 2:
                return None
            c = chunk[first]
            if a == b:
                linked = within(u, u, radius)
            else:  # only links across the two chunks; those inside a chunk are found at (a, a)
                left, right = np.flatnonzero(c == a), np.flatnonzero(c == b)
                linked = np.zeros((len(u), len(u)), bool)
                if len(left) and len(right):
                    hit = within(u[left], u[right], radius)
                    linked[np.ix_(left, right)] = hit
                    linked[np.ix_(right, left)] = hit.T
            return star_edges(u, linked)

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        out_a, out_b, held = [], [], 0
        for key, fp, chunk in runs(batches, ("key", "blk_a", "blk_b"), ("fp", "chunk")):
            got = flush(fp.view(np.uint64), chunk, key[1], key[2])
            if got is not None and len(got[0]):
                out_a.append(got[0].view(np.int64))
                out_b.append(got[1].view(np.int64))
                held += len(got[0])
            if held > 50_000:
                yield pa.record_batch([np.concatenate(out_a), np.concatenate(out_b)], schema=schema)
                out_a, out_b, held = [], [], 0
        if held:
            yield pa.record_batch([np.concatenate(out_a), np.concatenate(out_b)], schema=schema)

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, ...]):
    """(key, *value arrays) for each run of equal keys in sorted batches of longs; runs may span batches."""
    left: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*keys, *values)]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
        if not len(cols[0]):
            continue
        change = np.zeros(len(cols[0]), bool)
        for c in cols[: len(keys)]:
            change[1:] |= c[1:] != c[:-1]
        cutpoints = [0, *np.flatnonzero(change).tolist()]
        for i, j in itertools.pairwise(cutpoints):
            yield tuple(c[i] for c in cols[: len(keys)]), *(c[i:j] for c in cols[len(keys) :])
        left = [c[cutpoints[-1] :] for c in cols]
    if left is not None and len(left[0]):
        yield tuple(c[0] for c in left[: len(keys)]), *left[len(keys) :]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a fingerprint (as a signed long) for every row."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), ngram, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42, radius: int = 3, blocks: int = 5, cap: int = 1024
) -> DataFrame:
    """One row (doc_id, fp, component_id) for each input row; component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    fps = runtime.staged(fingerprints(docs, id_col, text_col, ngram, seed), "fingerprints")
    nodes = runtime.cut(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least_id")))
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << bounds[i + 1]) - (1 << bounds[i])) for i in keep) for keep in itertools.combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])).alias("key"))
    dealt = buckets.block_pairs(keyed, "key", "fp", cap)
    n = runtime.partitions(spark)
    ordered = dealt.select("key", "blk_a", "blk_b", "fp", "chunk").repartition(n, "key", "blk_a", "blk_b").sortWithinPartitions("key", "blk_a", "blk_b")
    edges = ordered.mapInArrow(_bucket_edges(radius), "a long, b long")
    comp = buckets.components(edges)
    least = comp.join(nodes, comp["node"] == nodes["fp"]).select("component", "least_id")
    least = runtime.cut(least.groupBy("component").agg(F.min("least_id").alias("group_id")))
    # only fingerprints in a group of several carry a label; all others stand alone
    labels = runtime.cut(comp.join(least, "component").select(F.col("node").alias("fp"), "group_id"))
    alone = nodes.join(labels, "fp", "left").select("fp", F.coalesce("group_id", "least_id").alias("group_id"))
    alone = runtime.cut(alone)
    return fps.join(alone, "fp").select("doc_id", "fp", F.expr(f"nullif(group_id, {NO_ID}L)").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` with one row left of each near-duplicate group: that of the smallest id (one of them, if repeated).

    A row without an id can't be named by the result: such rows stay, one for each distinct text.
    """
    found = runtime.staged(near_duplicates(docs, id_col, text_col, **how), "near-duplicates")
    best = runtime.cut(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    ids = docs[id_col].cast("long")
    single, several = best.where("n = 1"), best.where("n > 1")  # columns by frame, as the documents' may have any name
    one = docs.join(single, ids == single["doc_id"], "left_semi")
    many = docs.join(several, ids == several["doc_id"], "left_semi").dropDuplicates([id_col])
    unknown = docs.where(F.col(id_col).isNull()).dropDuplicates([text_col])
    return one.unionByName(many).unionByName(unknown)
