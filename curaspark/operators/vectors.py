"""The vector kernel: exact cosine k-NN, pairs within a radius, centroids.

``knn`` and ``links`` meet every query with every reference vector in dense blocks through Arrow. References within
``broadcast_bytes`` (counted first) are broadcast and queries never move; larger ones are packed into blocks of fixed size
that meet pairwise by a salted join, each block pair keeps k rows a query, and the window that merges them sees those only.
Similarities rank by round(sim, 9) descending, then id, so that ties don't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import columns as C
from . import graph

BROADCAST_BYTES = 64 << 20
BLOCK = 2048
WIDE_BLOCK, LEAST_BLOCK = 8192, 512


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def _clean(df: DataFrame, *extra: str) -> DataFrame:
    return df.where(F.col("embedding").isNotNull()).select("id", "label", F.col("embedding").cast("array<double>").alias("embedding"), *extra)


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of every row, larger first, ties to the left; minus infinity is never taken."""
    n = s.shape[1]
    if n > k:
        least = np.partition(s, n - k, axis=1)[:, n - k]
        taken = s >= least[:, None]
        for x in np.flatnonzero(taken.sum(axis=1) > k):  # ties at the k-th place
            at = np.flatnonzero(taken[x])
            taken[x, at[np.argsort(-s[x, at], kind="stable")[k:]]] = False
        cols = np.nonzero(taken)[1].reshape(len(s), k)
    else:
        cols = np.broadcast_to(np.arange(n), s.shape)
    order = np.argsort(-np.take_along_axis(s, cols, axis=1), axis=1, kind="stable")
    cols = np.take_along_axis(cols, order, axis=1)
    rows = np.broadcast_to(np.arange(len(s))[:, None], cols.shape)
    ok = np.take_along_axis(s, cols, axis=1) > -np.inf
    return rows[ok], cols[ok]


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal values, nulls among them, as equal small integers."""
    both = pa.chunked_array([a, b.cast(a.type)]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


def _meet(k: int, same_label: bool, exclude_self: bool, per_label: bool = False) -> Callable:
    """(query ids, labels, matrix) x (reference ids, labels, matrix), references in order of id -> a batch of the best k.

    Labels cut the product into slices: with ``same_label`` queries meet their own label's references only, with ``per_label``
    k references of every label are kept. Each slice is one matrix product and one selection over it.
    """

    def run(qi: pa.Array, ql: pa.Array, q: np.ndarray, ri: pa.Array, rl: pa.Array, r: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(qi) and len(ri):
            qc, rc = _codes(ql, rl)
            whole = np.arange(len(qi)), np.arange(len(ri))
            if same_label or per_label:
                slices = [(np.flatnonzero(qc == c) if same_label else whole[0], np.flatnonzero(rc == c)) for c in np.unique(rc)]
            else:
                slices = [whole]
            own = _codes(qi, ri) if exclude_self else None
            for x, y in slices:
                if not len(x):
                    continue
                sims = q[x] @ r[y].T
                s = np.round(sims, 9)
                if own is not None:
                    order = np.argsort(own[1][y], kind="stable")
                    mine = own[1][y][order]
                    lo, hi = np.searchsorted(mine, own[0][x]), np.searchsorted(mine, own[0][x], "right")
                    for step in range(int((hi - lo).max(initial=0))):
                        hit = np.flatnonzero(lo + step < hi)
                        s[hit, order[lo[hit] + step]] = -np.inf
                i, j = _best(s, k)
                found.append((x[i], y[j], sims[i, j]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.record_batch([qi.take(pa.array(cols[0])), ql.take(pa.array(cols[0])), ri.take(pa.array(cols[1])), rl.take(pa.array(cols[1])), pa.array(cols[2])], names=["id", "label", "nid", "nlabel", "sim"])

    return run


def _packed(df: DataFrame, block: int) -> DataFrame:
    """Rows as blocks (ids, labels, matrix bytes, width) of bounded size."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                m = _matrix(part.column(2))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in (0, 1)]
                yield pa.record_batch([*lists, pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], names=["ids", "labels", "m", "dim"])

    return df.mapInArrow(run, f"ids array<{kind}>, labels array<string>, m binary, dim int")


def _rows_of(batch: pa.RecordBatch, k: int, column: int) -> pa.Array:
    """The k-th list of a list column."""
    return batch.column(column).slice(k, 1).flatten()


def _block_of(batch: pa.RecordBatch, k: int, column: int, width: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[k].as_buffer()).reshape(-1, max(1, width))


def _bounded(refs: DataFrame, limit: int) -> pa.Table | None:
    """The references in order of id, if they take at most ``limit`` bytes."""
    n, width = refs.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if (n or 0) * ((width or 0) * 8 + 64) > limit:
        return None
    return refs.orderBy("id").toArrow()


def knn(queries: DataFrame, refs: DataFrame, k: int = 10, same_label: bool = False, exclude_self: bool = True, per_label: bool = False, broadcast_bytes: int = BROADCAST_BYTES, block: int = BLOCK) -> DataFrame:
    """id, label, nid, nlabel, sim, rank: the k nearest references of every query by cosine similarity.

    ``same_label`` keeps to references of the query's own label; ``per_label`` finds k of every label, ranked within each.
    Rows without an embedding take no part; fewer references than k give fewer rows.
    """
    q, r = _clean(queries), _clean(refs)
    spark = q.sparkSession
    runtime.ship(spark)
    kind, other = q.schema["id"].dataType.simpleString(), r.schema["id"].dataType.simpleString()
    schema = f"id {kind}, label string, nid {other}, nlabel string, sim double"
    meet = _meet(k, same_label, exclude_self, per_label)

    small = _bounded(r, broadcast_bytes)
    if small is not None:
        shared = spark.sparkContext.broadcast((small.column("id").combine_chunks(), small.column("label").combine_chunks(), _matrix(small.column("embedding").combine_chunks())))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ri, rl, m = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    p = b.slice(at, 512)
                    yield meet(p.column(0), p.column(1), _matrix(p.column(2)), ri, rl, m)

        found = q.mapInArrow(scan, schema)
    else:
        salts = max(1, -(-r.count() // (4 * block)))
        left = _packed(q, block).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        right = _packed(r.sortWithinPartitions("id"), block).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
        pairs = left.join(right.toDF("rids", "rlabels", "rm", "rdim", "salt"), "salt").select("ids", "labels", "m", "dim", "rids", "rlabels", "rm")

        def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x, width in enumerate(b.column(3).to_pylist()):
                    yield meet(_rows_of(b, x, 0), _rows_of(b, x, 1), _block_of(b, x, 2, width), _rows_of(b, x, 4), _rows_of(b, x, 5), _block_of(b, x, 6, width))

        found = pairs.mapInArrow(cross, schema)
    best = Window.partitionBy("id", "nlabel") if per_label else Window.partitionBy("id")
    return found.withColumn("rank", F.row_number().over(best.orderBy(F.round("sim", 9).desc(), "nid"))).where(F.col("rank") <= k)


def mean_knn_distance(near: DataFrame) -> DataFrame:
    """id, knn_dist: mean cosine distance to the neighbours found."""
    return near.groupBy("id").agg(F.avg(F.lit(1.0) - F.col("sim")).alias("knn_dist"))


def nearest(queries: DataFrame, refs: DataFrame, exclude_self: bool = False) -> DataFrame:
    """id, nid, distance of the nearest reference."""
    return knn(queries, refs, 1, exclude_self=exclude_self).select("id", "nid", (F.lit(1.0) - F.col("sim")).alias("distance"))


def _block_pairs(items: DataFrame, block: int) -> DataFrame:
    """Every pair of blocks of the items once: ids, m, dim, rids, rm, same.

    Blocks are packed once, checkpointed and numbered, so that both sides of the join see the same blocks whatever is
    recomputed. Block i meets the blocks at distance 0 to B / 2 round a ring of B, which is one triangle of all pairs, dealt
    evenly.
    """
    packed = graph.cut(_packed(_clean(items).sortWithinPartitions("id"), block))
    mark = F.monotonically_increasing_id()
    ranks = packed.select(mark.alias("mark")).withColumn("n", F.row_number().over(Window.orderBy("mark")) - 1)  # one row a block
    total = packed.count()
    blocks = packed.withColumn("mark", mark).join(ranks, "mark").drop("mark", "labels")
    half = total // 2
    left = blocks.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(half)))).where(f"not (d = {half} and {total} = {2 * half} and {half} > 0 and n >= {half})")
    left = left.withColumn("at", F.pmod(F.col("n") + F.col("d"), F.lit(max(1, total))))
    right = blocks.select(F.col("n").alias("at"), F.col("ids").alias("rids"), F.col("m").alias("rm"))
    return left.join(right, "at").select("ids", "m", "dim", "rids", "rm", (F.col("d") == 0).alias("same"))


def links(items: DataFrame, max_distance: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what pairs at cosine distance < ``max_distance`` connect.

    Each pair of blocks reports its local components as stars, at most one edge a row, so dense groups of copies don't turn
    into all their pairs.
    """
    runtime.ship(items.sparkSession)
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, (width, same) in enumerate(zip(b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True)):
                ids, m = _rows_of(b, x, 0), _block_of(b, x, 1, width)
                if not same:
                    ids, m = pa.concat_arrays([ids, _rows_of(b, x, 3)]), np.concatenate([m, _block_of(b, x, 4, width)])
                linked = 1.0 - m @ m.T < max_distance
                lab = np.arange(len(ids))
                while True:
                    new = np.minimum(lab, np.where(linked, lab[None, :], len(ids)).min(axis=1, initial=len(ids)))
                    new = np.minimum(new, new[new])
                    if (new == lab).all():
                        break
                    lab = new
                far = np.flatnonzero(lab != np.arange(len(ids)))
                yield pa.record_batch([ids.take(pa.array(far)), ids.take(pa.array(lab[far]))], names=["a", "b"])

    return _block_pairs(items, block).mapInArrow(run, f"a {kind}, b {kind}")


def similar_pairs(items: DataFrame, min_sim: float, block: int = BLOCK) -> DataFrame:
    """a, b, sim of all pairs a < b with cosine similarity of at least ``min_sim``: for thresholds that few pairs pass."""
    runtime.ship(items.sparkSession)
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, (width, same) in enumerate(zip(b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True)):
                s = np.round(_block_of(b, x, 1, width) @ _block_of(b, x, 4, width).T, 9)
                i, j = np.nonzero(s >= min_sim)
                p, q, sim = _rows_of(b, x, 0).take(pa.array(i)), _rows_of(b, x, 3).take(pa.array(j)), pa.array(s[i, j])
                less, more = pc.less(p, q), pc.greater(p, q)
                a, c = pc.if_else(less, p, q), pc.if_else(less, q, p)
                yield pa.record_batch([a, c, sim], names=["a", "b", "sim"]).filter(less if same else pc.or_(less, more))

    return _block_pairs(items, block).mapInArrow(run, f"a {kind}, b {kind}, sim double")


def _near_blocks(items: DataFrame, max_distance: float, block: int, bits: int, seed: int) -> DataFrame:
    """Pairs of blocks that may hold pairs at cosine distance < ``max_distance``, each once: ids, m, dim, rids, rm, same.

    Rows are dealt in order of a random-hyperplane signature, so near vectors share blocks and a hot signature is cut in many.
    Vectors at distance < D are nearer than sqrt(2 D) to one another; two blocks whose centres are farther apart than that and
    both radii can't hold such a pair. Nothing else is left out.
    """
    known = items.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("e"))
    kind = known.schema["id"].dataType.simpleString()
    n, width = known.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
    planes = np.random.RandomState(seed).randn(bits, width or 1)

    @F.pandas_udf("long")
    def signature(v: pd.Series) -> pd.Series:
        side = np.array(v.tolist(), float).reshape(len(v), -1) @ planes.T >= 0 if len(v) else np.zeros((0, bits), bool)
        return pd.Series((side << np.arange(bits)).sum(axis=1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                m = _matrix(part.column(1))
                centre = m.mean(axis=0)
                radius = np.sqrt(((m - centre) ** 2).sum(axis=1).max())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(0), pa.array(centre))]
                yield pa.record_batch([lists[0], pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32()), lists[1], pa.array([radius])], names=["ids", "m", "dim", "centre", "radius"])

    least = min(block, max(LEAST_BLOCK, -(-n // 16)))
    parts = max(1, -(-n // least))
    dealt = known.withColumn("sig", signature("e")).repartitionByRange(parts, "sig", "id").select("id", "e").coalesce(parts)  # no more blocks than these, however many partitions there are
    blocks = graph.cut(dealt.mapInArrow(pack, f"ids array<{kind}>, m binary, dim int, centre array<double>, radius double")).withColumn("at", F.monotonically_increasing_id())
    head = blocks.select("at", "centre", "radius")
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "rcentre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) - F.col("radius") - F.col("rradius")
    may = F.isnan(gap) | (gap < float(np.sqrt(2 * max(0.0, max_distance))) + 1e-9)
    pairs = head.join(head.toDF("rat", "rcentre", "rradius"), F.col("at") <= F.col("rat")).where(may)
    flip = F.pmod(F.xxhash64("at", "rat"), F.lit(2)) == 1  # so that no block is the right one of all its pairs
    pairs = graph.cut(pairs.select(F.when(flip, F.col("rat")).otherwise(F.col("at")).alias("at"), F.when(flip, F.col("at")).otherwise(F.col("rat")).alias("rat")))
    right = blocks.select(F.col("at").alias("rat"), F.col("ids").alias("rids"), F.col("m").alias("rm"))
    return pairs.join(blocks.select("at", "ids", "m", "dim"), "at").join(right, "rat").select("ids", "m", "dim", "rids", "rm", (F.col("at") == F.col("rat")).alias("same"))


def _within(batch: pa.RecordBatch, k: int, max_distance: float, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, distances) of the pairs of the k-th pair of blocks that are near and differ in id, a tile at a time."""
    width = batch.column(2)[k].as_py()
    x, y = _block_of(batch, k, 1, width), _block_of(batch, k, 4, width)
    own, other = _codes(_rows_of(batch, k, 0), _rows_of(batch, k, 3))
    for p in range(0, len(x), tile):
        for q in range(0, len(y), tile):
            s = x[p : p + tile] @ y[q : q + tile].T
            i, j = np.nonzero(s > 1.0 - max_distance - 1e-9)
            d = 1.0 - s[i, j]
            i, j = i + p, j + q
            near = (d < max_distance) & (own[i] != other[j])
            yield i[near], j[near], d[near]


def near_links(items: DataFrame, max_distance: float, block: int = WIDE_BLOCK, bits: int = 16, seed: int = 0) -> DataFrame:
    """a, b, n: rows whose ``n`` add up to a's number of items at distance < ``max_distance``; edges (a, b) connect what those connect.

    Each pair of blocks reports a row an item at most, so dense groups of copies never become all their pairs.
    """
    runtime.ship(items.sparkSession)
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, same in enumerate(b.column(5).to_pylist()):
                ids = _rows_of(b, k, 0)
                shift = 0 if same else len(ids)
                ids = ids if same else pa.concat_arrays([ids, _rows_of(b, k, 3)])
                n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for i, j, _ in _within(b, k, max_distance):
                    n += np.bincount(i, minlength=len(ids))
                    if not same:
                        n += np.bincount(j + shift, minlength=len(ids))
                    graph.merge(root, i, j + shift)
                some = np.flatnonzero(n)
                yield pa.record_batch([ids.take(pa.array(some)), ids.take(pa.array(root[some])), pa.array(n[some])], names=["a", "b", "n"])

    return _near_blocks(items, max_distance, block, bits, seed).mapInArrow(run, f"a {kind}, b {kind}, n long")


def near_pairs(items: DataFrame, max_distance: float, block: int = WIDE_BLOCK, bits: int = 16, seed: int = 0) -> DataFrame:
    """a, b, distance of all pairs a < b at distance < ``max_distance``: as many rows as there are pairs."""
    runtime.ship(items.sparkSession)
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, same in enumerate(b.column(5).to_pylist()):
                for i, j, d in _within(b, k, max_distance):
                    p, q = _rows_of(b, k, 0).take(pa.array(i)), _rows_of(b, k, 3).take(pa.array(j))
                    less = pc.less(p, q)
                    found = pa.record_batch([pc.if_else(less, p, q), pc.if_else(less, q, p), pa.array(d)], names=["a", "b", "distance"])
                    yield found.filter(less) if same else found

    return _near_blocks(items, max_distance, block, bits, seed).mapInArrow(run, f"a {kind}, b {kind}, distance double")


def centroids(items: DataFrame, by: list[str], normalise_first: bool = False) -> DataFrame:
    """by..., centroid: l2 of the mean of raw (or normalised) vectors."""
    v = C.l2(F.col("embedding")) if normalise_first else F.col("embedding")
    flat = items.where(F.col("embedding").isNotNull()).select(*by, F.posexplode(v).alias("pos", "x"))
    mean = flat.groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    rows = mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return rows.select(*by, C.l2(F.col("v")).alias("centroid"))


def image_items(samples: DataFrame) -> DataFrame:
    """Detections (hash, pos, label, confidence, embedding) to image items: mean raw vector, first label, largest confidence.

    Images without any embedding vanish.
    """
    head = samples.groupBy("hash").agg(F.min_by("label", "pos").alias("label"), F.max("confidence").alias("confidence"))
    flat = samples.where(F.col("embedding").isNotNull()).select("hash", F.posexplode("embedding").alias("k", "x"))
    mean = flat.groupBy("hash", "k").agg(F.avg("x").alias("x")).groupBy("hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("embedding"))
    return mean.join(head, "hash").select(F.col("hash").alias("id"), "label", "embedding", "confidence")
