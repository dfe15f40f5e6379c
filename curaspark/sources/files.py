"""Readers and writers of image folders, manifests, ledgers, evaluation files, thresholds and snapshots."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of images.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")

#: The name that manifests, ledgers and evaluation files give an image's hash, and the prefix of work lists' tags.
DISK_KEY, QUEUE_TAG = "vix_hash", "vixq:"

BOX = T.ArrayType(T.DoubleType())
EVAL = T.StructType([T.StructField(DISK_KEY, T.StringType()), T.StructField("gt", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("bbox", BOX)]))), T.StructField("pred", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("bbox", BOX), T.StructField("conf", T.DoubleType())])))])
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("image_hash", "src_path", "batch_id", "ingested_at", "label_version")] + [T.StructField("tags", T.ArrayType(T.StringType()))])
LEDGER = f"ts_utc string, event string, {DISK_KEY} string, batch_id string, reviewer_id string, decision string, scores map<string, double>, thr_version string, extra string, prev_hash string, entry_hash string"


def scan_images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """src_path, image_hash (sha256 of the bytes) of the images below a folder; the bytes are dropped unless asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ok = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES)
    return raw.where(ok).select(F.regexp_replace("path", "^file:", "").alias("src_path"), F.sha2("content", 256).alias("image_hash"), *(["content"] if content else []))


def hash_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), sha256 of every file: the shape that ``operators.export.verify`` compares."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    top = os.path.abspath(folder).rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/*", "/")
    return raw.select(F.replace(plain, F.lit(top), F.lit("")).alias("path"), F.sha2("content", 256).alias("sha256"))


def rotate(table: DataFrame, folder: str, name: str = "routing") -> None:
    """Write a table as ``name`` and keep the one before as ``name``_prev."""
    spark = table.sparkSession
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    now, before = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (name, f"{name}_prev"))
    fs = now.getFileSystem(conf)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}_new")
    table.write.mode("overwrite").parquet(f"{folder}/{name}_new")
    if fs.exists(now):
        fs.delete(before, True)
        fs.rename(now, before)
    fs.rename(fresh, now)


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines folder, such as the relabel log."""
    rows.write.mode("append").json(path)


def ingest(images: DataFrame, manifest: DataFrame, batch_id: str, label_version: str = "v1", tags: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """New manifest entries and skipped images: known hashes, and repeats inside the batch after the first path."""
    if {"golden", "eval"} <= set(tags):
        raise ValueError("a batch is golden or eval, not both")
    first = F.row_number().over(Window.partitionBy("image_hash").orderBy("src_path"))
    known = manifest.select("image_hash", F.lit(True).alias("known")).distinct()
    j = images.withColumn("nth", first).join(known, "image_hash", "left")
    new = j.where("nth = 1 and known is null").select("image_hash", "src_path", F.lit(batch_id).alias("batch_id"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ingested_at"), F.lit(label_version).alias("label_version"), F.array(*map(F.lit, [*tags, f"batch:{batch_id}"])).alias("tags"))
    return new, j.where("nth > 1 or known").select("image_hash", "src_path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    on_disk = T.StructType([T.StructField(DISK_KEY if f.name == "image_hash" else f.name, f.dataType) for f in MANIFEST])
    return spark.read.schema(on_disk).json(path).withColumnRenamed(DISK_KEY, "image_hash")


def append_manifest(entries: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append entries whose hash is not there yet."""
    if existing is not None:
        entries = entries.join(existing.select("image_hash"), "image_hash", "left_anti")
    entries.dropDuplicates(["image_hash"]).withColumnRenamed("image_hash", DISK_KEY).write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger records with seq (the line's number in the file) and raw; a byte order mark is dropped and torn lines are skipped.

    Lines are read in parallel blocks of the file; a line's number is its place in its block and the lines of the blocks before.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    lines = lines.withColumn("place", place).join(F.broadcast(before), "block").select((F.col("before") + F.col("place")).alias("seq"), F.regexp_replace("value", "^\ufeff", "").alias("raw"))
    rec = F.from_json("raw", LEDGER, {"mode": "PERMISSIVE"})
    return lines.where("trim(raw) <> ''").withColumn("r", rec).where("r.event is not null and r.entry_hash is not null").select("seq", "raw", "r.*").withColumnRenamed(DISK_KEY, "image_hash")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions (hash, decision) of a review tool, as JSON lines."""
    return spark.read.schema("hash string, decision string").json(path).where("hash is not null")


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """A hash manifest (path, sha256) as JSON lines."""
    return spark.read.schema("path string, sha256 string").json(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation images from JSON lines or one JSON array."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    array = bool(head) and head[0].value.lstrip("﻿ \t").startswith("[")
    return spark.read.schema(EVAL).option("multiLine", array).json(path).withColumnRenamed(DISK_KEY, "image_hash")


def eval_tables(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truths and predictions of evaluation images as rows for ``operators.evaluation``."""
    cells = [F.col("x.bbox")[i].alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))]
    gt = images.select(F.col("image_hash").alias("image_id"), F.posexplode("gt").alias("gt_id", "x")).select("image_id", "gt_id", "x.label", *cells)
    pred = images.select(F.col("image_hash").alias("image_id"), F.posexplode("pred").alias("pred_id", "x")).select("image_id", "pred_id", "x.label", *cells, F.coalesce("x.conf", F.lit(0.0)).alias("conf"))
    return gt, pred


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("conf double, correct double").json(path)


def json_argument(value: str):
    """A JSON file's or an inline JSON value."""
    if os.path.exists(value):
        with open(value, encoding="utf-8-sig") as f:
            return json.load(f)
    return json.loads(value)


def synthetic_detections(manifest: DataFrame) -> DataFrame:
    """One full-image detection an image: label = parent folder, confidence from the digest of the hash."""
    parts = F.split("src_path", r"[/\\]")
    label = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("object")
    part = F.conv(F.substring(F.sha2("image_hash", 256), 1, 8), 16, 10).cast("long") % 1000
    return manifest.select(F.col("image_hash").alias("hash"), F.lit(0).alias("pos"), label.alias("label"), F.round(0.4 + 0.6 * part / 1000, 3).alias("confidence"), *[F.lit(x).alias(c) for c, x in (("cx", 0.5), ("cy", 0.5), ("w", 1.0), ("h", 1.0))])


def voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """filename, label, cx, cy, w, h of annotation files in XML."""
    from ..operators import boxes

    raw = spark.read.format("xml").option("rowTag", "annotation").schema("filename string, size struct<width: double, height: double>, object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>").load(path)
    o = raw.select("filename", "size", F.explode("object").alias("o"))
    c = boxes.corners(*[F.col(f"o.bndbox.{k}") for k in ("xmin", "ymin", "xmax", "ymax")], F.col("size.width"), F.col("size.height"))
    return o.select("filename", F.col("o.name").alias("label"), *[v.alias(n) for v, n in zip(c, ("cx", "cy", "w", "h"), strict=True)])


def save_thresholds(thresholds: DataFrame, path: str, meta: dict) -> None:
    """Thresholds as one small JSON document; infinity becomes null."""
    rows = {r.label: {"conf_thr": r.conf_thr, "dist_thr": None if r.dist_thr == float("inf") else r.dist_thr, "n_support": r.n_support} for r in thresholds.collect()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"meta": meta, "thresholds": rows}, f, ensure_ascii=False, indent=2)


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    doc = json_argument(path)
    rows = [(k, float(v["conf_thr"]), float("inf") if v["dist_thr"] is None else float(v["dist_thr"]), int(v["n_support"])) for k, v in doc.get("thresholds", {}).items()]
    return spark.createDataFrame(rows, "label string, conf_thr double, dist_thr double, n_support long")


def resolve_tag(samples: DataFrame, tag: str) -> str:
    """A tag as given, or ``batch:<tag>`` if only that exists; an unknown tag stays as it is."""
    hit = {r.t for r in samples.select(F.explode("tags").alias("t")).where(F.col("t").isin(tag, f"batch:{tag}")).distinct().collect()}
    return f"batch:{tag}" if tag not in hit and f"batch:{tag}" in hit else tag


def detection_items(samples: DataFrame, any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Detections of samples (hash, tags, dets) that pass the tag filter: id = hash:pos, with batch and split from the tags."""
    from ..functions import columns as C

    s = samples.where(C.tagged(F.col("tags"), list(any_of), list(none_of)))
    d = s.select("hash", C.namespace(F.col("tags"), "batch").alias("batch"), C.namespace(F.col("tags"), "split").alias("split"), F.posexplode("dets").alias("pos", "d"))
    return d.select(F.concat_ws(":", "hash", "pos").alias("id"), "hash", "pos", "d.label", "d.confidence", "d.embedding", "batch", "split")


def pixel_embedding(images: DataFrame, size: int = 16) -> DataFrame:
    """src_path, image_hash, embedding of images with their content: grey levels of a size x size thumbnail.

    Needs an image library on the executors.
    """
    import pandas as pd

    @F.pandas_udf("array<double>")
    def embed(content: pd.Series) -> pd.Series:
        import io

        from PIL import Image

        def one(raw):
            im = Image.open(io.BytesIO(raw)).convert("L").resize((size, size))
            return [p / 255.0 for p in im.getdata()]

        return content.map(one)

    return images.select("src_path", "image_hash", embed("content").alias("embedding"))


def model_detections(images: DataFrame, predict, schema: str = "path string, pos int, label string, confidence double, cx double, cy double, w double, h double") -> DataFrame:
    """Detections of an external model: ``predict`` maps an iterator of pandas batches, loading the model once a task."""
    return images.mapInPandas(predict, schema)
