"""Structured streaming beside the batch verbs: idempotent ingest and live review rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def ingest_stream(spark: SparkSession, folder: str, manifest: str, checkpoint: str, batch_id: str, tags: list[str] = ()):
    """Stream new images below a folder into a manifest; a hash enters once, whatever is replayed."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    ok = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*files.SUFFIXES)
    images = raw.where(ok).select(F.regexp_replace("path", "^file:", "").alias("src_path"), F.sha2("content", 256).alias("image_hash"))

    def add(batch: DataFrame, _: int) -> None:
        known = files.read_manifest(spark, manifest)
        new, _skipped = files.ingest(batch, known, batch_id, tags=tags)
        files.append_manifest(new, manifest)

    return images.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def review_rates(ledger: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Share of route records sent to review by batch and event-time window."""
    r = ledger.where("event = 'route'").withWatermark("ts", late)
    return r.groupBy(F.window("ts", window), "batch_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") == "review").cast("double")).alias("review_rate"))
