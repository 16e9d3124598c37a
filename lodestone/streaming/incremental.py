"""Incremental batches as streams: new manifest files update the index, logged answers give latencies by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(ddl).option("mode", "PERMISSIVE").json(path)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs `handle` on every micro-batch; the checkpoint makes a restart go on where it stopped."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latency_windows(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Answers, mean and approximate 95th percentile of latency by window of event time `ts`; later rows than `late` are dropped by the watermark."""
    rows = stream.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.expr("percentile_approx(value, 0.95, 10000)").alias("p95_value")
    ).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value", "p95_value")
