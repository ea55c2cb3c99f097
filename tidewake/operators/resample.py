"""One row per time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import guarded


def first_per_bucket(df: DataFrame, keys: list[str], seconds: int, columns: list[str], ts: str = "ts_unix", composite: bool = False) -> DataFrame:
    """keys, bucket and columns: of the bucket's first row, or (composite) each column's first value that is not null."""
    df = df.withColumn("bucket", F.floor(F.col(ts) / seconds))
    order = F.struct(ts, "event_id")
    if not composite:
        first = df.groupBy(*keys, "bucket").agg(F.min_by(F.struct(*columns), order).alias("x"))
        return first.select(*keys, "bucket", "x.*")
    return df.groupBy(*keys, "bucket").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns))


@guarded
def nearest_to_start(df: DataFrame, keys: list[str], seconds: int, columns: list[str], ts: str = "ts_unix", least: int = 2) -> DataFrame:
    """The bucket's row nearest to its start, which is its first; a new point_idx; trips of fewer than ``least`` rows go."""
    out = first_per_bucket(df, keys, seconds, columns, ts)
    out = out.withColumn("point_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("bucket")) - 1)
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


@guarded
def one_per_bucket(df: DataFrame, keys: list[str], seconds: int, ts: str = "ts_unix") -> DataFrame:
    """Rows whose bucket is another than the row's before."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    b = F.floor(F.col(ts) / seconds)
    return df.withColumn("_b", b).withColumn("_p", F.lag("_b").over(w)).where("_p is null or _p != _b").drop("_b", "_p")


@guarded
def every_kth(df: DataFrame, keys: list[str], k: int, ts: str = "ts_unix") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    return df.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % k == 0).drop("_i")
