"""Operators over images as they arrive: stateless, so a batch plan serves each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files


def on_arrival(spark: SparkSession, path: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Read new files under `path`, apply `process` to their samples and append Parquet; the
    file source and the checkpoint make it exactly-once per file."""

    def each(batch: DataFrame, epoch: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_grid(events: DataFrame, minutes: int = 60, columns: int = 64) -> DataFrame:
    """Events as a raster that grows in time: rows are time windows, columns user groups, the
    sample is the sum of values. Works on a batch and, with a watermark, on a stream."""
    rows = events.withWatermark("ts", f"{minutes} minutes") if events.isStreaming else events
    g = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), (F.col("user_id") % columns).cast("int").alias("x"))
    return g.agg(F.sum("value").alias("v"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "x", "v", "n")
