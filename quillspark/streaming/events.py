"""Streaming twins of the batch reports, and incremental upkeep of an index by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """A stream of the Parquet files that come to path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(events: DataFrame, time_col: str) -> DataFrame:
    """Events whose time, which may lack a zone, is a timestamp, as a watermark needs it."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(events: DataFrame, time_col: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, by, n) in tumbling windows; rows later than the watermark are dropped."""
    w = F.window(time_col, width)
    return timed(events, time_col).withWatermark(time_col, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def once(events: DataFrame, key: str, time_col: str, late: str = "2 days") -> DataFrame:
    """Each key's first event within the watermark: idempotent intake of repeated requests."""
    return timed(events, time_col).withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time_col: str, user: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user, start, end, n) of runs of events with no gap longer than gap."""
    w = F.session_window(time_col, gap)
    return timed(events, time_col).withWatermark(time_col, late).groupBy(w, user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Works off all that is there in micro-batches, each given to handle once or, after a failure, again under the same number."""
    query = df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def replace_dirty(path: str, build: Callable[[DataFrame], DataFrame], by: str = "novel_id") -> Callable[[DataFrame, int], None]:
    """A handler that rebuilds the partitions of an index that a batch of chapters touches; repeating a batch changes nothing."""

    def handle(batch: DataFrame, _: int) -> None:
        build(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    return handle
