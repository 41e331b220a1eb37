"""Jobs and search queries over time. The plans run on batch and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import search_trigger, trimmed
from ..functions.unroll import unroll

# States after which a job does not change any more.
TERMINAL_STATES = ("complete", "cancelled", "error")


def job_progress_latest(events: DataFrame) -> DataFrame:
    """Latest state per job_id by (ts, event_id).

    As a stream it needs update or complete mode; the state is one row per job. Many events of
    one job are combined before the shuffle.
    """
    latest = events.groupBy("job_id").agg(
        F.max_by(F.struct("state", "progress", "ts", "event_id"), F.struct("ts", "event_id")).alias("_l")
    )
    return latest.select("job_id", "_l.*").withColumn("is_terminal", F.col("state").isin(*TERMINAL_STATES))


def debounced_queries_stream(queries: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Last query of every burst of a user, once ``gap`` has passed without another one; for streams.

    A finished table goes through ``debounced_queries``, which also splits users with very many events.
    """
    events = queries.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    last = events.groupBy("user_id", F.session_window("ts", gap).alias("_w")).agg(
        F.max_by(F.struct("q", "ts", "event_id"), F.struct("ts", "event_id")).alias("_l"), F.count(F.lit(1)).alias("n_events")
    )
    return last.select("user_id", F.col("_l.ts").alias("ts"), F.col("_l.event_id").alias("event_id"), trimmed("_l.q").alias("q"), "n_events").filter(search_trigger("q"))


def debounced_queries(queries: DataFrame, gap_seconds: int, bucket_seconds: int | None = None) -> DataFrame:
    """The same over a finished table, safe for users with very many events.

    A query fires when the next one of its user is at least a gap away, so it has to see one gap
    ahead only. Events are cut into time buckets, and the ones that start a bucket are copied
    back into the one before; a user is then spread over as many tasks as there are buckets.
    """
    bucket = max(bucket_seconds or gap_seconds * 64, gap_seconds)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    home = F.floor(us / F.lit(bucket * 1_000_000))
    back = F.floor((us - gap_seconds * 1_000_000) / F.lit(bucket * 1_000_000))
    timed = queries.select("user_id", "ts", "event_id", "q", us.alias("_us"), home.alias("_home"), back.alias("_back"))
    both = F.when(F.col("_back") < F.col("_home"), F.array("_home", F.col("_home") - 1)).otherwise(F.array("_home"))
    cut = unroll(timed, both, "_bucket")
    w = Window.partitionBy("user_id", "_bucket").orderBy("_us", "event_id")
    ahead = cut.withColumn("_next", F.lead("_us").over(w)).filter(F.col("_bucket") == F.col("_home"))
    fires = F.col("_next").isNull() | (F.col("_next") - F.col("_us") > gap_seconds * 1_000_000)
    return ahead.filter(fires).select("user_id", "ts", "event_id", trimmed("q").alias("q")).filter(search_trigger("q"))


#: Batches between two snapshots.
SNAPSHOT_EVERY = 50


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished tables ``prefix``N in a folder, in order."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name = status.getPath().getName()
        if name.startswith(prefix) and fs.exists(context._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix(prefix)))
    return sorted(found)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _latest_of(spark: SparkSession, out: str, upto: int | None = None, before: int | None = None) -> DataFrame | None:
    """Latest row of each job in the newest snapshot (older than ``before``) and the batches behind it (to ``upto``)."""
    snapshots = [n for n in _numbers(spark, f"{out}/snapshots", "upto=") if before is None or n < before]
    batches = [n for n in _numbers(spark, f"{out}/batches", "batch=") if (not snapshots or n > snapshots[-1]) and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{out}/snapshots/upto={snapshots[-1]}")] if snapshots else []
    if batches:
        parts.append(spark.read.option("basePath", f"{out}/batches").parquet(*[f"{out}/batches/batch={n}" for n in batches]))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].select(*parts[0].columns))
    columns = [c for c in rows.columns if c not in ("job_id", "batch")]
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct("batch", *columns), "batch").alias("_l"))
    return newest.select("job_id", "_l.batch", *[f"_l.{c}" for c in columns])


def write_progress_batch(changed: DataFrame, batch: int, out: str, every: int = SNAPSHOT_EVERY) -> None:
    """One batch of the kept table: the changed rows, and after every ``every`` batches a snapshot of all jobs.

    A batch that is repeated writes the same tables again. What lies before the last snapshot but one is deleted, so a
    reader of the last one loses nothing, and the folder holds two snapshots and 2 * ``every`` batches at most.
    """
    spark = changed.sparkSession
    changed.write.mode("overwrite").parquet(f"{out}/batches/batch={batch}")
    if batch % every != every - 1:
        return
    _latest_of(spark, out, upto=batch, before=batch).write.mode("overwrite").parquet(f"{out}/snapshots/upto={batch}")
    kept = _numbers(spark, f"{out}/snapshots", "upto=")[-2:]
    if len(kept) == 2:
        for n in [n for n in _numbers(spark, f"{out}/snapshots", "upto=") if n < kept[0]]:
            _delete(spark, f"{out}/snapshots/upto={n}")
        for n in [n for n in _numbers(spark, f"{out}/batches", "batch=") if n <= kept[0]]:
            _delete(spark, f"{out}/batches/batch={n}")


def start_job_progress(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Follow a folder of progress files; every trigger writes the jobs that changed to the kept table in ``out``.

    ``read_job_progress`` gives the latest row of each job, from the last snapshot and the batches behind it.
    """
    events = spark.readStream.schema(schema).parquet(path)

    def write(changed: DataFrame, batch: int) -> None:
        write_progress_batch(changed, batch, out, every)

    return job_progress_latest(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def read_job_progress(spark: SparkSession, out: str) -> DataFrame:
    """Latest row of each job of the table that ``start_job_progress`` keeps; its cost does not grow with the triggers."""
    found = _latest_of(spark, out)
    if found is None:
        raise ValueError(f"no batch in {out}")
    return found.drop("batch")
