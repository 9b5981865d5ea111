"""Incremental runs: what is done stays done, and new rows are added once. The output table is the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def append_pending(spark: SparkSession, requested: DataFrame, path: str, keys: list[str], work=lambda df: df) -> int:
    """Works off the requested rows whose keys the table at `path` lacks, and appends the results; how many were pending."""
    try:
        done = spark.read.parquet(path).select(*keys)
        todo = requested.join(done, keys, "left_anti")
    except Exception as e:  # noqa: BLE001 - no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = requested
    todo = todo.dropDuplicates(keys)
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(path)
    return n


def resume_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], work=lambda df: df) -> StreamingQuery:
    """The same for a stream: each micro-batch is reduced to what is pending and appended."""

    def each(batch: DataFrame, _: int) -> None:
        append_pending(batch.sparkSession, batch, path, keys, work)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str = "ts", group: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window and group, with late rows up to the watermark. Batch or stream."""
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    table = marked.groupBy(F.window(ts, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return table.select(F.col("w.start").alias("window_start"), group, "n", F.round("total", 4).alias("total"))
