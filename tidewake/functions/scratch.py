"""The folder that driver and executors share, where results are settled before they are read twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in a local session without that setting one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _own_dirs.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="tidewake-")
        _own_dirs[sc.applicationId] = named
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and read from then on, so that all readers see the same partitions, and none needs its executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as settled() has it, in files of which a reader takes the columns it needs; for what is large or read often."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewake/{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}"
    known = [(i, c) for i, (c, kind) in enumerate(df.dtypes) if kind != "void"]  # files hold no column of no type
    kept = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(f"c{i}" for i, _ in known))
    kept.write.option("compression", "snappy").parquet(path)
    back, held = spark.read.schema(kept.schema).parquet(path), dict(known)
    return back.select(*((F.col(f"c{i}") if i in held else F.lit(None)).alias(c) for i, c in enumerate(df.columns)))


FEW_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df (rows of a few numbers, settled), to be broadcast where a count proves it has at most FEW_ROWS rows."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df
