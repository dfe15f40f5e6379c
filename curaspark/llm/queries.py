"""The driver's queries for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, labelled, mixing, passages, quality, simhash, tokenbin, tokencount, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("embedding"))
    return topk.search(rows, rows.where(F.col("vec_id") % 50 == 0))


def _judged(scores: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", F.coalesce(labelled.remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 3, 1)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mix.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.read_documents(tokenbin.write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under the pieces of the box's sentencepiece file, read as a unigram table.

    No public unigram vocabulary is on the box and tokenizers are never trained, so scores are the ones of that file, which
    rank merges rather than being log probabilities, and its control pieces match like any other, as they do in the library
    that the counts are tested against. With a true unigram file as ``vocabulary`` nothing else changes.
    """
    import public_tokenizers

    return tokencount.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"), htmltext.fitted())


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_binary": op6_token_binary,
    "op7_simhash": op7_simhash,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_token_counts": op9_token_counts,
    "op10_html_text": op10_html_text,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": """
        with e as (
            select vec_id, [cast(floor(256 * cast(x as double)) as double) for x in embedding] as v
            from embeddings
            where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ), scored as (
            select q.vec_id as query_id, q.v, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from (select distinct vec_id, v from e where vec_id % 50 = 0) q join e c on c.vec_id <> q.vec_id
        ), ranked as (
            select query_id, cast(row_number() over (partition by query_id, v order by score desc, vec_id) as integer) as rank, vec_id, score from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
}
