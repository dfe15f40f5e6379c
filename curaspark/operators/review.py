"""Review write-back over immutable samples: tag events and their fold, resolutions, queues, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files

#: Spellings a review tool may send.
REJECTS, CONFIRMS = ("false_alarm", "reject", "rejected"), ("", "confirm", "confirmed")


def fold_tags(samples: DataFrame, events: DataFrame) -> DataFrame:
    """hash, tags after tag events (hash, tag, op add/remove, seq): the last operation on a tag wins."""
    base = samples.select("hash", F.explode_outer("tags").alias("tag"), F.lit("add").alias("op"), F.lit(-1).cast("long").alias("seq"))
    last = base.unionByName(events.select("hash", "tag", "op", F.col("seq").cast("long").alias("seq"))).groupBy("hash", "tag").agg(F.max_by("op", "seq").alias("op"))
    tags = last.groupBy("hash").agg(F.array_sort(F.collect_list(F.when((F.col("op") == "add") & F.col("tag").isNotNull(), F.col("tag")))).alias("tags"))
    return samples.select("hash").join(tags, "hash", "left").select("hash", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def normalise(decisions: DataFrame) -> DataFrame:
    """Pulled decisions (hash, decision) as outcome confirmed / rejected / relabel and the label, if one was given."""
    d = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    out = F.when(d.isin(*REJECTS), "rejected").when(d.isin(*CONFIRMS), "confirmed").otherwise("relabel")
    return decisions.withColumn("outcome", out).withColumn("label", F.when(F.col("outcome") == "relabel", F.trim("decision")))


def unknown_ids(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (hash) that no sample has."""
    return ids.select("hash").distinct().join(samples.select("hash"), "hash", "left_anti")


def resolve(samples: DataFrame, decisions: DataFrame, first_seq: int = 0) -> DataFrame:
    """Tag events of resolutions: confirmed (or relabelled) samples become golden, rejected ones rejected.

    Golden is added and review stays, as open counts expect. Any unknown id fails the whole batch before a row is made.
    """
    unknown = unknown_ids(samples, decisions).limit(5).collect()
    if unknown:
        raise ValueError(f"unknown ids: {[r.hash for r in unknown]}")
    n = normalise(decisions)
    tag = F.when(F.col("outcome") == "rejected", "rejected").otherwise("golden")
    return n.select("hash", tag.alias("tag"), F.lit("add").alias("op"), (F.lit(first_seq) + F.monotonically_increasing_id()).alias("seq"))


def dismiss(ids: DataFrame, tags: list[str] = ("review",), op: str = "remove", first_seq: int = 0) -> DataFrame:
    """Tag events that take ids out of review (or, with op add, put them back)."""
    return ids.select("hash", F.explode(F.array(*map(F.lit, tags))).alias("tag"), F.lit(op).alias("op"), (F.lit(first_seq) + F.monotonically_increasing_id()).alias("seq"))


def worklists(samples: DataFrame, prefix: str = files.QUEUE_TAG) -> DataFrame:
    """name, n of the work lists that tags name."""
    t = samples.select(F.explode("tags").alias("tag")).where(F.startswith("tag", F.lit(prefix)))
    return t.groupBy(F.substring("tag", len(prefix) + 1, 1 << 20).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def emission(ids: DataFrame, queue: str, predict: str, seq: int) -> DataFrame:
    """Queue emission records (queue, predict, seq, id)."""
    return ids.select(F.lit(queue).alias("queue"), F.lit(predict).alias("predict"), F.lit(seq).alias("seq"), "id")


def admit_batch(samples: DataFrame, batch: str, verdict: str, force: bool = False, admit: bool = True, first_seq: int = 0) -> tuple[DataFrame, dict]:
    """Tag events that admit (or take back) a batch, and the ledger record with the pool's digest before and after.

    A BLOCK verdict refuses the batch unless forced; a refusal makes no tag event.
    """
    mine = F.array_contains("tags", f"batch:{batch}")
    refused = admit and verdict == "BLOCK" and not force
    op = "add" if admit else "remove"
    ids = samples.where(F.lit(False) if refused else mine).select("hash")
    events = dismiss(ids, ["admitted"], op, first_seq)
    pool = lambda s: content_hash(s.where(F.array_contains("tags", "admitted")), "hash").first()[0]
    after = fold_tags(samples, events)
    record = {"event": "batch_admit" if admit else "batch_unadmit", "batch_id": batch, "decision": "REFUSED" if refused else "FORCED" if force and verdict == "BLOCK" else "OK", "extra": {"pool_before": pool(samples), "pool_after": pool(after)}}
    return events, record


# snapshots ---------------------------------------------------------------------


def composition(manifest: DataFrame, ledger_reasons: DataFrame | None = None) -> DataFrame:
    """included (by manifest tags, not live ones) and excluded samples with their latest reasons."""
    out = manifest.select("image_hash", F.arrays_overlap("tags", F.array(F.lit("golden"), F.lit("anchor"))).alias("included"), F.arrays_overlap("tags", F.array(F.lit("rejected"))).alias("rejected"))
    out = out.select("image_hash", (F.col("included") & ~F.col("rejected")).alias("included"))
    return out if ledger_reasons is None else out.join(ledger_reasons, "image_hash", "left")


def content_hash(rows: DataFrame, key: str = "image_hash", digest: str | None = None) -> DataFrame:
    """One row, hash: digest of the sorted keys (and their digests), combined shard by shard."""
    x = F.col(key) if digest is None else F.concat_ws("=", key, digest)
    r = rows.select(x.alias("x"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2).alias("b"))
    s = r.groupBy("b").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("x"))), 256).alias("s"))
    return s.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat("b", "s")))), 256).alias("hash"))


def box_digests(boxes: DataFrame) -> DataFrame:
    """image_hash, digest of each image's boxes at four decimals."""
    line = F.concat_ws(",", "label", *[F.floor(F.col(c) * 10000 + 0.5).cast("string") for c in ("cx", "cy", "w", "h")])
    return boxes.groupBy("image_hash").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256).alias("digest"))


def restore(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What to do to get back to a snapshot: hash, action (add, drop)."""
    a, b = current.select("image_hash"), snapshot.where("included").select("image_hash")
    return b.subtract(a).withColumn("action", F.lit("add")).unionByName(a.subtract(b).withColumn("action", F.lit("drop")))
