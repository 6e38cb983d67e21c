"""Structured Streaming over append-only fact folders: keyed upserts and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.functions.scratch import drop, scratch_root
from terrane.operators.change import latest


def _stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # A table is one file or a folder of files; the file source takes a folder, or a pattern that names the file.
    head, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return source.parquet(path) if folder else source.option("pathGlobFilter", name).parquet(head)


def _run_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/terrane/stream-{uuid.uuid4().hex}"


def replay(spark: SparkSession, path: str, columns: list[str], key: str, version: list[str]) -> DataFrame:
    """The latest row of every ``key`` after a stream over ``path`` has run through, a micro-batch at a time.

    Each batch is merged with the state before it and written as the next version, named by the batch's number; a
    batch that is run again writes the same version, so the result is exactly-once.
    """
    root = _run_folder(spark)
    wanted = [F.col(v) for v in version]

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch
        if number:
            rows = batch.unionByName(session.read.parquet(f"{root}/state/{number - 1}"))
        latest(rows, key, wanted).select(*columns).write.mode("overwrite").parquet(f"{root}/state/{number}")
        if number > 1:  # the version before stays, as its batch may be run again
            drop(session, f"{root}/state/{number - 2}")

    q = (
        _stream(spark, path)
        .select(*columns)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{root}/log")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    done = _last_version(spark, f"{root}/state")
    if done is None:
        return spark.read.parquet(path).select(*columns).limit(0)
    return spark.read.parquet(f"{root}/state/{done}")


def _last_version(spark: SparkSession, folder: str) -> int | None:
    """The largest number that names a finished table in ``folder``; a query's progress tells of its last batches only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    found = [x.getPath() for x in files.listStatus(at)]
    names = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(map(int, names), default=None)


def _exists(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def windows(spark: SparkSession, path: str, width: str, late: str = "10 minutes") -> DataFrame:
    """``start``, ``event_type``, ``n``, ``total`` by tumbling event-time windows of ``width``.

    The query runs in update mode: each batch writes the windows that it has changed, and of each window the latest row
    is kept, over all batches of the run. A stream without any row gives none.
    """
    root = _run_folder(spark)
    rows = _stream(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = flat.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    kind = "start timestamp, event_type string, n long, total double, batch int"
    out = spark.read.schema(kind).parquet(f"{root}/out") if _exists(spark, f"{root}/out") else spark.createDataFrame([], kind)
    newest = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return newest.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "x.n", "x.total")
