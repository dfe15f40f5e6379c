"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled rows (y, *columns) outside the held-out fold, those of the smallest id hash.

    Only ids that the documents have are drawn. The ids drawn are at most ``bound`` rows, which is what makes them safe to
    broadcast. Null ids or labels don't count; an id labelled more than once takes its largest label; an id that several rows
    have counts once, by its least row.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("__id"), F.struct(*[F.col(c) for c in columns]).alias("__row"))
    drawn = known.join(rows.select("__id"), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(bound)
    return rows.join(F.broadcast(drawn), "__id").groupBy("__id", "y").agg(F.min("__row").alias("__row")).select("y", "__row.*")
