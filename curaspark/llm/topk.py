"""Exact top-k inner products by Fagin's threshold algorithm (operator 1).

Queries and candidates are packed into blocks; each block of queries meets every block of candidates exactly once. In a
candidate block each dimension has its rows in order of value. A query walks these lists from the end its sign prefers, a
slice of depth at a time, scores the rows it has not seen in full, and stops once the bound - the sum over dimensions of
weight times the last value read, which no unseen row can pass - is below its kth score. The kth score is carried from one
candidate block to the next, so later blocks stop sooner.

Cases: null vectors, vectors with a null or non-finite component and null ids take no part; rows that repeat an id and its
vector count once; rows with the query's id are its own and no candidates; a shorter vector counts as padded with zeros;
ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


class Lists:
    """Sorted per-dimension lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.rows = rows
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(np.ascontiguousarray(rows.T), self.order, axis=1)
        self.most = float(np.abs(rows).max(initial=0))
        self.single = rows.astype(np.float32)
        self.double = None

    def scorer(self, q: np.ndarray):
        """Exact inner products of chosen rows with a query, in the cheapest arithmetic that is exact."""
        reach = self.most * float(np.abs(q).sum())
        if reach < 1 << 24:
            w = q.astype(np.float32)
            return lambda at: (self.single[at] @ w).astype(np.int64)
        if reach < 1 << 53:
            if self.double is None:
                self.double = self.rows.astype(float)
            w = q.astype(float)
            return lambda at: (self.double[at] @ w).astype(np.int64)
        return lambda at: np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in self.rows[at]], object)


def threshold(lists: Lists, qid: int, q: np.ndarray, k: int, top: list[tuple[int, int]], stats: dict | None = None) -> list[tuple[int, int]]:
    """``top`` - the best (score, id) so far, best first - updated with a block of candidates."""
    n = lists.n
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    weight_up, weight_down = q[up].tolist(), q[down].tolist()
    score = lists.scorer(q)
    seen = np.zeros(n, bool)
    kth = top[k - 1][0] if len(top) >= k else None
    if not len(up) and not len(down):
        at = np.flatnonzero(lists.ids != qid)
        at = at[np.argsort(lists.ids[at], kind="stable")[:k]]
        return sorted([*top, *((0, int(i)) for i in lists.ids[at])], key=lambda x: (-x[0], x[1]))[:k]
    lo, step, left = 0, max(1, n // 64), n
    while left:
        hi = min(n, lo + step)
        fresh = np.zeros(n, bool)
        fresh[lists.order[up, n - hi : n - lo].ravel()] = True
        fresh[lists.order[down, lo:hi].ravel()] = True
        fresh &= ~seen
        seen |= fresh
        at = np.flatnonzero(fresh)
        left -= len(at)
        if len(at):
            s, ids = score(at), lists.ids[at]
            good = ids != qid
            if kth is not None:
                good &= s >= kth
            elif len(s) > 4 * k:
                good &= s >= np.partition(s, len(s) - 2 * k)[len(s) - 2 * k] if (ids != qid).sum() > 2 * k else True
            s, ids = s[good], ids[good]
            if len(s):
                pick = np.lexsort((ids, -s))[:k] if s.dtype != object else sorted(range(len(s)), key=lambda i: (-s[i], ids[i]))[:k]
                top = sorted([*top, *((int(s[i]), int(ids[i])) for i in pick)], key=lambda x: (-x[0], x[1]))[:k]
                kth = top[k - 1][0] if len(top) >= k else None
        bound = sum(w * int(v) for w, v in zip(weight_up, lists.values[up, n - hi], strict=True)) + sum(w * int(v) for w, v in zip(weight_down, lists.values[down, hi - 1], strict=True))
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + len(at)
        if kth is not None and bound < kth:  # at a tie an unseen row could still have a smaller id
            break
        lo, step = hi, step * 2
    return top


def search(
    candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_block: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query; vectors are arrays of whole numbers."""
    spark = candidates.sparkSession
    runtime.ship(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<long>").alias("v"))

    def pack(tag: int, most: int):
        """Rows (id, v, key), rows of a key together, as blocks of at most ``most`` rows of one key."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(key, ids, vs):
                wide = max((len(v) for v in vs), default=0)
                rows = np.zeros((len(vs), wide), "<i8")
                for i, v in enumerate(vs):
                    rows[i, : len(v)] = v
                small = np.int16 if np.abs(rows).max(initial=0) < 1 << 15 else np.int64
                one = [[tag], [key], [wide], [small().itemsize], [np.array(ids, "<i8").tobytes()], [rows.astype(small).tobytes()]]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                return pa.record_batch([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], names=["tag", "key", "wide", "item", "ids", "rows"])

            last, ids, vs = None, [], []
            for b in batches:
                flat, offsets = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
                offsets = (offsets - offsets[0]).tolist()
                for r, (name, key) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    if ids and (key != last or len(ids) >= most):
                        yield out(last, ids, vs)
                        ids, vs = [], []
                    last = key
                    ids.append(name)
                    vs.append(flat[offsets[r] : offsets[r + 1]])
            if ids:
                yield out(last, ids, vs)

        return run

    schema = "tag int, key int, wide int, item int, ids binary, rows binary"
    rows_c, rows_q = clean(candidates), clean(queries).dropDuplicates(["id", "v"])
    n, nq = rows_c.count(), rows_q.count()
    salts, groups = max(1, -(-n // block)), max(1, -(-nq // query_block))
    # queries form ``groups`` sets of about query_block rows, candidates ``salts`` sets of blocks; every pair of sets is one
    # task's work, as a search of all queries against all rows demands
    q = rows_q.withColumn("key", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups)).cast("int"))
    q = q.repartition(groups, "key").sortWithinPartitions("key").mapInArrow(pack(0, query_block), schema).withColumnRenamed("key", "g")
    q = runtime.staged(q, "query-blocks", compression="none")
    c = rows_c.withColumn("key", F.lit(0)).mapInArrow(pack(1, block), schema).drop("key")
    c = c.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    c = runtime.staged(c, "candidate-blocks", compression="none")
    meet_c = c.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    meet_q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cols = ["g", "salt", "tag", "wide", "item", "ids", "rows"]
    dealt = meet_q.select(cols).unionByName(meet_c.select(cols)).repartition(max(runtime.partitions(spark), 1), "g", "salt").sortWithinPartitions("g", "salt", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None}

        def unpack(r):
            ids = np.frombuffer(r["ids"], "<i8")
            return ids, np.frombuffer(r["rows"], "<i2" if r["item"] == 2 else "<i8").astype(np.int64).reshape(len(ids), r["wide"])

        def fit(rows, wide):
            return rows if rows.shape[1] == wide else np.pad(rows, ((0, 0), (0, wide - rows.shape[1])))

        def drain():
            if state.get("held"):
                wide = max([state["q"][1].shape[1], *(r.shape[1] for _, r in state["held"])])
                lists = Lists(np.concatenate([i for i, _ in state["held"]]), np.concatenate([fit(r, wide) for _, r in state["held"]]))
                qs = fit(state["q"][1], wide)
                state["top"] = [threshold(lists, int(i), v, k, t) for i, v, t in zip(state["q"][0], qs, state["top"], strict=True)]
            state["held"] = []

        def ended():
            drain()
            rows = [(int(i), j, t) for j, (i, top) in enumerate(zip(state["q"][0], state["top"], strict=True)) for t in top]
            return pa.record_batch(
                [pa.array([state["key"][0]] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2][1] for r in rows], pa.int64()), pa.array([r[2][0] for r in rows], pa.int64())],
                names=["g", "j", "query_id", "vec_id", "score"],
            )

        for b in batches:
            for r in b.to_pylist():
                key = (r["g"], r["salt"])
                if key != state["key"]:
                    if state.get("q"):
                        yield ended()
                    state = {"key": key, "q": None, "held": [], "top": []}
                if r["tag"] == 0:  # the sets of queries come first
                    ids, rows = unpack(r)
                    if state["q"]:
                        wide = max(rows.shape[1], state["q"][1].shape[1])
                        ids, rows = np.concatenate([state["q"][0], ids]), np.concatenate([fit(state["q"][1], wide), fit(rows, wide)])
                    state["q"] = (ids, rows)
                    state["top"] = [[] for _ in ids]
                elif state["q"]:
                    state["held"].append(unpack(r))
                    if sum(len(i) for i, _ in state["held"]) >= block:
                        drain()
        if state.get("q"):
            yield ended()

    found = dealt.mapInArrow(run, "g long, j int, query_id long, vec_id long, score long")
    best = Window.partitionBy("g", "j").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
