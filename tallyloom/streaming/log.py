"""An append log as a stream: records once each within a watermark, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(stream: DataFrame, keys: list[str], time_col: str, lateness: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time_col: str, by: list[str], size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return stream.withWatermark(time_col, lateness).groupBy(w.alias("window"), *by).count().select("window.start", "window.end", *by, F.col("count").alias("n"))
