"""Streaming forms: incremental ingest, duplicates within a watermark, activity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How late a mail may come and still be joined with its duplicates.
LATENESS = "48 hours"


def message_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Each key once within the lateness; the state of older keys is dropped."""
    return stream.filter(F.col(key).isNotNull()).withWatermark(at, LATENESS).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, session_start, session_end, n_events): runs of events without a longer gap."""
    out = stream.withWatermark(at, LATENESS) if stream.isStreaming else stream
    return out.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def hourly(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Events per key and hour."""
    out = stream.withWatermark(at, LATENESS) if stream.isStreaming else stream
    return out.groupBy(F.window(at, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("hour"), "n_events")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there, once, exactly: the checkpoint remembers which files are done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
