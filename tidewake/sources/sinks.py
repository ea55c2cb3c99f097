"""Writers: partitioned and sorted Parquet, delimited text, and small summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def points(df: DataFrame, path: str, by: list[str] | None = None, sort: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet in ranges of the first sort column, sorted within a file, in folders of ``by``."""
    if sort:
        df = df.repartitionByRange(sort[0]).sortWithinPartitions(*sort)
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def delimited(df: DataFrame, path: str, sep: str, header: bool = False, sort: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Text rows; a total order where sort names columns."""
    (df.orderBy(*sort) if sort else df).write.mode(mode).option("sep", sep).option("header", header).csv(path)


def summary(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """One file of an aggregate that is small by nature."""
    getattr(df.coalesce(1).write.mode(mode).option("header", True), kind)(path)


def file_stats(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_trajectories"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A stage's result, written and read back: a resume point.  A stage that is there already is read, not written."""
    spark = df.sparkSession
    path = f"{folder}/{name}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def gathered(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their vectors, joined by key.  A row without a vector, or with several, is an error when it is read."""
    n = F.count("*").over(Window.partitionBy(*keys))
    vectors = vectors.withColumn("_found", n)
    out = rows.join(vectors, keys, "left")
    right = F.when(F.col("_found") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("rows and vectors do not match")).cast("boolean"))
    return out.where(right).drop("_found")
