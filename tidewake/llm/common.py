"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither repeat its work nor need its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewake/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df (rows of a few numbers), to be broadcast if a count proves it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back the memory that it freed: workers live on from stage to stage, and what one
    stage's arrays took would otherwise stand beside the next one's."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return tidied


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def grouped(batches: Iterator[pa.RecordBatch], size: Column | int, weight: str | None = None) -> Iterator[pa.Table]:
    """Joins small batches until they hold ``size`` rows, or ``size`` bytes of column ``weight``; splits none."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.column(b.schema.get_field_index(weight)).nbytes if weight else b.num_rows
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)
