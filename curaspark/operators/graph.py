"""Connected components of edge lists, by rounds of joins and pre-aggregated minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder."""
    runtime.checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge list (a, b).

    A round takes the smallest label among neighbours, lets the label's own node take it too, and jumps to the label's
    label, so chains shrink in logarithmically many rounds and no hub is gathered in one task.
    """
    e = edges.where("a <> b")
    e = cut(e.select("a", "b").union(e.select("b", "a")).distinct())
    lab = e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("p"))
    for _ in range(rounds):
        lab = cut(lab)
        near = e.join(lab.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("pb").alias("m"))
        best = lab.join(near, "node").select("node", "p", F.least("p", "m").alias("q"))
        hook = best.groupBy(F.col("p").alias("node")).agg(F.min("q").alias("h"))
        best = cut(best.join(hook, "node", "left").select("node", "p", F.least("q", F.coalesce("h", "q")).alias("q")))
        jump = best.select(F.col("node").alias("q"), F.col("q").alias("j"))
        new = cut(best.join(jump, "q", "left").select("node", "p", F.least("q", F.coalesce("j", "q")).alias("n")))
        done = new.where("p <> n").limit(1).count() == 0
        lab = new.select("node", F.col("n").alias("p"))
        if done:
            return lab.select("node", F.col("p").alias("component"))
    raise RuntimeError("components: raise rounds")


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of rows i and j; each row points at its tree's first row."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def components_in_one(edges: DataFrame) -> DataFrame:
    """``components`` of an edge list that fits one task, in that task and without rounds."""
    runtime.ship(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0), b.column(1)) for b in batches]
        if not parts:
            return
        ends = pa.concat_arrays([p[0] for p in parts] + [p[1] for p in parts]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        a, b = np.split(place[ends.indices.to_numpy()], 2)
        ids, root = ends.dictionary.take(order), np.arange(len(order))
        merge(root, a, b)
        yield pa.record_batch([ids, ids.take(pa.array(root))], names=["node", "component"])

    return edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")
