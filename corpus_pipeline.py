"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written and read again
before the next. All but the last return the columns of documents. Null, empty and repeated rows are treated as the stage's
operator says; an empty table passes every stage and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curaspark.llm import decontam, mixing, quality, runtime, simhash, tokenbin
from curaspark.llm.queries import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled rows of the documents given."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.expanded(mixing.mixed(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the token files written for the mix: doc_id, start, n_tokens, ids_crc32 for each of its rows."""
    import public_tokenizers

    return tokenbin.read_documents(tokenbin.write_blocks(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID binary output", token_files),
]

#: Classifier, fingerprints, alignment and tokenizer can't be written in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = runtime.staged_last(spark, stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
