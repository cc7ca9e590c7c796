"""Incremental corpora: new files through Structured Streaming, once each, in bounded steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, path: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], files: int = 1000) -> StreamingQuery:
    """Feeds files that are new since the checkpoint to ``each(batch, id)``, ``files`` at a time, and stops when there are no more. Resumable: an interrupted run goes on where it was."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, start, n): events of a stream or a table counted in tumbling windows; those later than the watermark are dropped from a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")
