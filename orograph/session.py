"""Session settings this library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call sites of every expression cost more than the expressions in plans of this size.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    Spark sizes a table by its files and does not count the rows that an explode adds, so it may take one that grows with
    the input for a small one and collect it on the driver.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that driver and executors share: the one of ``spark.checkpoint.dir``.

    Where none is set, as in tests, a folder in the warehouse is set for this session.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute a table that several later steps read, once, and keep it in the shared folder.

    This runs a job at once. A lost executor loses nothing, and the plan after it starts at the table.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
