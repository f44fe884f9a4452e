"""Structured Streaming forms of the resumable steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they come, ``per_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, late: str, window: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` per window and keys; rows later than ``late`` are let go by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def checkpointed_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has come since the last run to ``path``; a run that stops resumes at its checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def distinct_progress(log: DataFrame, pattern: str) -> DataFrame:
    """Distinct numbers in a growing log (column ``value``): the pages done so far."""
    return log.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("page")).dropDuplicates(["page"])
