"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(session: SparkSession) -> str:
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or session.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The table, computed once and kept in the folder of ``spark.checkpoint.dir``.

    That folder is shared by driver and executors, so a lost executor loses nothing. Where none is
    set, as in tests, a folder in the warehouse is used.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The table, written as Parquet to the folder that ``checkpointed`` uses, and read again."""
    session = df.sparkSession
    path = f"{_folder(session)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)
