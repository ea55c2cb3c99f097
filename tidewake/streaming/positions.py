"""Positions as a stream: the batch operators that have a natural form there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType | str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def trips(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end and n of trips that end after more than ``gap`` without a position."""
    sessions = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_bucket(stream: DataFrame, key: str, time: str, value: str, bucket: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """The value of the first position of each bucket."""
    first = stream.withWatermark(time, late).groupBy(F.window(time, bucket).alias("w"), key).agg(F.min_by(value, time).alias(value))
    return first.select(key, F.col("w.start").alias("bucket"), value)
