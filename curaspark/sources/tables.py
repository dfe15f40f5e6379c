"""Engine inputs derived from the driver's tables with arithmetic that every SQL engine evaluates alike (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, embedding, confidence, batch, split, role, fab: the universal input of the embedding analytics."""
    e = table(spark, sf_dir, "embeddings")
    fold = F.floor(F.col("vec_id") / 10).cast("long") % 10
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        (F.lit(0.4) + F.lit(0.6) * ((F.col("vec_id") * 37) % 1000) / F.lit(1000.0)).alias("confidence"),
        F.concat(F.lit("w"), (F.col("vec_id") % 8).cast("string")).alias("batch"),
        F.when(fold < 6, "train").when(fold < 8, "val").otherwise("test").alias("split"),
        F.when(F.col("vec_id") % 5 < 2, "golden").when(F.col("vec_id") % 5 == 2, "anchor").otherwise("candidate").alias("role"),
        F.concat(F.lit("F"), (F.floor(F.col("vec_id") / 7).cast("long") % 4).cast("string")).alias("fab"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, role, batch and a normalised centre box."""
    i = items(spark, sf_dir).select("id", "label", "role", "batch")

    def wave(mul: int, mod: int, low: float, span: float):
        return F.lit(low) + F.lit(span) * ((F.col("id") * mul) % mod) / F.lit(float(mod - 1))

    return i.select(
        "*",
        wave(31, 97, 0.05, 0.9).alias("cx"),
        wave(17, 89, 0.05, 0.9).alias("cy"),
        F.when(F.col("id") % 61 == 0, F.lit(0.0005)).otherwise(wave(13, 53, 0.02, 0.2)).alias("w"),
        wave(29, 47, 0.02, 0.2).alias("h"),
    )


def _centre(shift: int, mul: int, mod: int):
    return F.lit(0.2) + F.lit(0.6) * (((F.col("event_id") - shift) * mul) % mod) / F.lit(float(mod - 1))


def eval_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0")
    return e.select(F.floor(F.col("event_id") / 10).cast("long").alias("image_id"), F.col("event_id").alias("gt_id"), F.col("event_type").alias("label"), _centre(0, 7, 101).alias("cx"), _centre(0, 11, 103).alias("cy"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))


def eval_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("truth"))
    p = e.where("event_id % 2 = 1 and event_id % 11 <> 0").select("event_id", "event_type").join(before, "event_id")
    return p.select(
        F.floor(F.col("event_id") / 10).cast("long").alias("image_id"),
        F.col("event_id").alias("pred_id"),
        F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("truth")).alias("label"),
        (_centre(1, 7, 101) + ((F.col("event_id") * 13) % 12) / F.lit(100.0)).alias("cx"),
        _centre(1, 11, 103).alias("cy"),
        F.lit(0.1).alias("w"),
        F.lit(0.1).alias("h"),
        (((F.col("event_id") * 7919) % 10007) / F.lit(10007.0)).alias("conf"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("image_hash"),
        F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("reviewer_id"),
        F.concat(F.lit("w"), (F.col("user_id") % 8).cast("string")).alias("batch_id"),
        F.when(kind.isin("view", "click"), "route").when(kind == "signup", "queue_emit").otherwise("review").alias("event"),
        F.when(kind == "view", "review").when(kind == "click", "pass").when(kind == "purchase", "confirmed").when(kind == "error", "false_alarm").otherwise("hardneg").alias("decision"),
    )


def calib(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id").select("doc_id", F.col("quality").cast("double").alias("correct"), (F.lit(0.5) + F.lit(0.5) * ((F.col("n_chars") * 7) % 1000) / F.lit(1000.0)).alias("conf"))


#: The same views as DuckDB common table expressions.
SQL = {
    "items": """items as (select vec_id id, concat('c', cast(label as varchar)) as label, cast(embedding as double[]) embedding,
        cast(0.4 as double) + cast(0.6 as double) * ((vec_id * 37) % 1000) / cast(1000 as double) confidence, concat('w', cast(vec_id % 8 as varchar)) batch,
        case when cast(floor(vec_id / 10) as bigint) % 10 < 6 then 'train' when cast(floor(vec_id / 10) as bigint) % 10 < 8 then 'val' else 'test' end split,
        case when vec_id % 5 < 2 then 'golden' when vec_id % 5 = 2 then 'anchor' else 'candidate' end as role,
        concat('F', cast(cast(floor(vec_id / 7) as bigint) % 4 as varchar)) fab from embeddings)""",
    "boxes": """boxes as (select id, label, role, batch, cast(0.05 as double) + cast(0.9 as double) * ((id * 31) % 97) / cast(96 as double) cx,
        cast(0.05 as double) + cast(0.9 as double) * ((id * 17) % 89) / cast(88 as double) cy,
        case when id % 61 = 0 then cast(0.0005 as double) else cast(0.02 as double) + cast(0.2 as double) * ((id * 13) % 53) / cast(52 as double) end w,
        cast(0.02 as double) + cast(0.2 as double) * ((id * 29) % 47) / cast(46 as double) h from items)""",
    "eval_gt": """eval_gt as (select cast(floor(event_id / 10) as bigint) image_id, event_id gt_id, event_type as label,
        cast(0.2 as double) + cast(0.6 as double) * ((event_id * 7) % 101) / cast(100 as double) cx, cast(0.2 as double) + cast(0.6 as double) * ((event_id * 11) % 103) / cast(102 as double) cy,
        cast(0.1 as double) w, cast(0.1 as double) h from events where event_id % 2 = 0)""",
    "eval_pred": """eval_pred as (select cast(floor(p.event_id / 10) as bigint) image_id, p.event_id pred_id, case when p.event_id % 7 = 0 then p.event_type else g.event_type end as label,
        cast(0.2 as double) + cast(0.6 as double) * (((p.event_id - 1) * 7) % 101) / cast(100 as double) + ((p.event_id * 13) % 12) / cast(100 as double) cx,
        cast(0.2 as double) + cast(0.6 as double) * (((p.event_id - 1) * 11) % 103) / cast(102 as double) cy, cast(0.1 as double) w, cast(0.1 as double) h,
        ((p.event_id * 7919) % 10007) / cast(10007 as double) conf
        from events p join events g on g.event_id = p.event_id - 1 where p.event_id % 2 = 1 and p.event_id % 11 <> 0)""",
    "ledger": """ledger as (select event_id seq, ts, concat('u', cast(user_id as varchar)) image_hash, concat('r', cast(event_id % 4 as varchar)) reviewer_id,
        concat('w', cast(user_id % 8 as varchar)) batch_id, case event_type when 'view' then 'route' when 'click' then 'route' when 'signup' then 'queue_emit' else 'review' end event,
        case event_type when 'view' then 'review' when 'click' then 'pass' when 'purchase' then 'confirmed' when 'error' then 'false_alarm' else 'hardneg' end decision from events)""",
    "calib": """calib as (select d.doc_id, cast(l.quality as double) correct, cast(0.5 as double) + cast(0.5 as double) * ((d.n_chars * 7) % 1000) / cast(1000 as double) conf
        from documents d join labels l on l.doc_id = d.doc_id)""",
}


def with_views(*names: str) -> str:
    """``with`` clause of the views named, in order."""
    return "with recursive " + ", ".join(SQL[n] for n in names)
