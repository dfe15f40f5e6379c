"""Session helpers: shipping this package to executors, the shared folder, staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import runtime as package

BATCH_ROWS, _BATCH = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Texts are long, so Arrow batches are held to BATCH_ROWS rows, where the session leaves Spark's default of 10,000: that
    bounds what a worker and its executor hold at once.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    package.ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    return package.checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/curaspark-{spark.sparkContext.applicationId}"


_made: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete this application's staged tables; frames that read them are of no use afterwards."""
    _delete(spark, _own(spark))
    _made.clear()


def mark() -> int:
    """A point in the order of staged tables, for ``drop_since``."""
    return len(_made)


def drop_since(spark: SparkSession, point: int) -> None:
    """Delete the tables staged since a point but the last, which was made from them."""
    for folder in _made[point:-1]:
        _delete(spark, folder)
    del _made[point:-1]


def drop_named(spark: SparkSession, point: int, *names: str) -> None:
    """Delete the tables staged under these names since a point."""
    for folder in _made[point:]:
        if folder.rpartition("/")[2].rpartition("-")[0] in names:
            _delete(spark, folder)
            _made.remove(folder)


def staged_last(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Stage the outcome of a step and delete all tables staged on the way to it, its own input among them.

    What remains is the outcome alone, as files, so nothing that is left needs them.
    """
    out = staged(df, name)
    drop_since(spark, 0)
    return out


def staged(df: DataFrame, name: str, tidy: bool = False, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows never recomputes it, whichever executors are lost.

    With ``tidy`` the shuffle files of the write are deleted as soon as it has ended, as nothing reads them any more, instead
    of whenever the driver's garbage collector finds them. Staged tables stay until ``staged_last`` or ``sweep``, as the
    frames returned read them.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    try:
        if tidy:
            spark.conf.set(_CLEANUP, "true")
        df.write.options(**options).parquet(path)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before)
    _made.append(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
