"""A folder of stages: tables that are computed once, written, and read from there afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame


class StageStore:
    """Stages of a plan below an explicit path that driver and executors share.

    ``keep`` writes a table under a name and gives the written one back with its own schema, so the plans
    behind it start at a scan and stay small, and a lost executor costs no more than the running stage.
    A stage of that name that was finished before (by this store, or by one that is continued with
    ``resume``) is not computed again.
    """

    def __init__(self, path: str, resume: bool = False):
        self.path, self.resume, self.done = path.rstrip("/"), resume, set()

    def _finished(self, df: DataFrame, name: str) -> bool:
        if name in self.done or not self.resume:
            return name in self.done
        context = df.sparkSession.sparkContext
        marker = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return bool(marker.getFileSystem(context._jsc.hadoopConfiguration()).exists(marker))

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}"
        if not self._finished(df, name):
            df.write.mode("overwrite").parquet(path)
        self.done.add(name)
        return df.sparkSession.read.schema(df.schema).parquet(path)
