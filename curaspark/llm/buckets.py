"""Comparing the members of join buckets pair by pair in blocks of bounded size, and connected components of the links found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

BROADCAST_BYTES = 16 << 20


def block_pairs(rows: DataFrame, key: str, member: str, cap: int) -> DataFrame:
    """Deal bucket members to tasks that each hold two chunks of at most about ``cap`` members of one bucket.

    ``rows`` has a bucket key and a member (long). Buckets of one are dropped, as they hold no pair. A bucket with more
    members than ``cap`` is cut into c chunks by a hash of the member, and chunk r goes to the block pairs (r, j) for
    every j, so each pair of members meets in some block and no task ever holds a whole hot bucket.
    Returns key, blk_a <= blk_b, member, chunk.
    """
    counts = runtime.cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    # few buckets hold a pair: they are broadcast where their count shows them small, so that rows alone in theirs never move
    joined = rows.join(F.broadcast(counts) if counts.count() * 32 <= BROADCAST_BYTES else counts, key)
    chunks = F.ceil(F.col("__n") / F.lit(cap)).cast("int")
    chunk = F.pmod(F.xxhash64(member, F.lit(7)), chunks).cast("int")
    dealt = joined.select(key, *[c for c in rows.columns if c != key], chunks.alias("__c"), chunk.alias("chunk"))
    other = F.explode(F.sequence(F.lit(0), F.col("__c") - 1))
    return dealt.withColumn("__j", other).select(
        key,
        F.least("chunk", "__j").alias("blk_a"),
        F.greatest("chunk", "__j").alias("blk_b"),
        *[c for c in rows.columns if c != key],
        "chunk",
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list of longs: one row (node, component) per node that has an edge.

    Rounds of neighbour minimum, hooking of the parent and pointer jumping; each round is joins and minima that Spark
    pre-aggregates, so a hub with very many edges is never gathered in one task, and each round's table is checkpointed.
    The component is the smallest node. Self loops and repeated edges are allowed; an empty list gives no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = runtime.cut(e.union(e.select(F.col("v"), F.col("u"))).distinct())
    lab = runtime.cut(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")))
    for _ in range(rounds):
        nb = lab.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        # smallest parent among the neighbours of u
        m = e.join(nb, "v").groupBy("u").agg(F.min("pv").alias("m"))
        cand = lab.join(m, "u", "left").select("u", "p", F.least("p", F.coalesce("m", "p")).alias("q"))
        # the parent takes the minimum too, so that whole trees hook at once
        hook = cand.groupBy(F.col("p").alias("u")).agg(F.min("q").alias("h"))
        step = cand.join(hook, "u", "left").select("u", "p", F.least("q", F.coalesce("h", "q")).alias("q"))
        step = runtime.cut(step)
        up = step.select(F.col("u").alias("q"), F.col("q").alias("qq"))
        new = runtime.cut(step.join(up, "q", "left").select("u", F.col("p").alias("old"), F.least("q", F.coalesce("qq", "q")).alias("p")))
        moved = new.where("old != p").limit(1).count()
        lab = new.select("u", "p")
        if not moved:
            return lab.select(F.col("u").alias("node"), F.col("p").alias("component"))
    raise RuntimeError("components: no fixed point; raise rounds")
