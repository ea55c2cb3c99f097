"""Scans along trajectories of any length, in ranges.

A window by trajectory puts a whole trajectory into one task.  Here the trajectories of more than ``rows`` rows are cut into ranges
of time, and windows go by trajectory and range; what a range must know of those before it (the last value, how many breaks)
comes from summaries, a row a range, which are scanned and joined back.  The results are those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.names import free
from ..functions.scratch import few, settled, stored

RANGE_ROWS = 1_000_000
MOST_RANGES = 1024  # more, of fewer rows than RANGE_ROWS, are not made: ranges are longer then


def with_ranges(df: DataFrame, keys: list[str], ts: str = "ts_unix", rows: int = RANGE_ROWS, name: str = "range") -> DataFrame:
    """df with the number of a row's range, null where its trajectory has at most ``rows`` rows.

    Rows are dealt by ranges of keys and ts, which rows of one ts do not straddle, and stored, so that scans read the columns they
    need; a null ts is in a trajectory's first range."""
    n, *marks = free(df, "_n", *(f"_{k}" for k in keys))
    of = dict(zip(keys, marks))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(m)) for k, m in of.items()))
    sizes = stored(df.groupBy(*keys).agg(F.count("*").alias(n)).withColumnsRenamed(of))
    total, most = sizes.agg(F.sum(n), F.max(n)).first()
    if most is None or most <= rows:
        return df.withColumn(name, F.lit(None).cast("int"))
    m = max(min(MOST_RANGES, math.ceil(total / rows)), math.ceil(total / RANGE_ROWS))
    long = few(sizes.where(F.col(n) > rows))  # at most one in ``rows`` rows
    dealt = df.join(long, same, "left").repartitionByRange(m, *keys, ts)
    return stored(dealt.withColumn(name, F.when(F.col(n).isNotNull(), F.spark_partition_id())).drop(n, *marks))


def last(name: str, w: WindowSpec) -> Column:
    return F.last(name, ignorenulls=True).over(w)


def total(name: str, w: WindowSpec) -> Column:
    return F.sum(name).over(w)


def carried(df: DataFrame, keys: list[str], ranges: str, parts: dict[str, tuple[Column, Callable[[str, WindowSpec], Column]]]) -> DataFrame:
    """df with a column a part: its summaries (an aggregate of a range), folded over the ranges before the row's own; null
    in the first range, and where a trajectory has none."""
    of = dict(zip([*keys, ranges], free(df, *(f"_{k}" for k in (*keys, ranges)))))
    sums = df.where(F.col(ranges).isNotNull()).groupBy(*keys, ranges).agg(*(c.alias(n) for n, (c, _) in parts.items()))
    w = Window.partitionBy(*keys).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    before = settled(sums.select(*(F.col(k).alias(m) for k, m in of.items()), *(fold(n, w).alias(n) for n, (_, fold) in parts.items())))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(of[k])) for k in keys), F.col(ranges) == F.col(of[ranges]))
    return df.join(few(before), same, "left").drop(*of.values())


def latest(column: str, order: list[str]) -> Column:
    """An aggregate: the last value that is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))


def forward_filled(df: DataFrame, keys: list[str], order: list[str], columns: list[str], ranges: str) -> DataFrame:
    """Each of columns by its last value that is not null, up to the row."""
    columns = [c for c in columns if c in df.columns]
    names = free(df, *(f"_{c}_before" for c in columns))
    df = carried(df, keys, ranges, {n: (latest(c, order), last) for n, c in zip(names, columns)})
    w = Window.partitionBy(*keys, ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), n) for n, c in zip(names, columns)}).drop(*names)


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], ranges: str, first: str) -> DataFrame:
    """df with new columns, the values of the row before, also where that is in an earlier range; and ``first``: whether there is none."""
    whole = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    (tail,) = free(df, "_tail")
    df = carried(df, keys, ranges, {tail: (F.max_by(whole, F.struct(*order)), last)})
    w = Window.partitionBy(*keys, ranges).orderBy(*order)
    here, start = F.lag(whole).over(w), F.row_number().over(w) == 1
    df = df.withColumns({first: start & F.col(tail).isNull(), tail: F.when(start, F.col(tail)).otherwise(here)})
    return df.withColumns({n: F.col(tail)[n] for n in columns}).drop(tail)


def running_total(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, ranges: str) -> DataFrame:
    """df with the sum of a column (not null) up to the row."""
    (before,) = free(df, "_before")
    df = carried(df, keys, ranges, {before: (F.sum(column), total)})
    w = Window.partitionBy(*keys, ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(column).over(w) + F.coalesce(before, F.lit(0))).drop(before)


def runs(df: DataFrame, key: str, file: str, row: str, name: str = "run", rows: int = RANGE_ROWS) -> DataFrame:
    """df with the number (from 0, within a file) of the run of consecutive rows with one key; a null key is a key.

    A file is read in pieces of ``rows`` rows; a run goes on across them."""
    piece, was, step, first = free(df, "_piece", "_was", "_step", "_first")
    df = df.withColumn(piece, F.floor(F.col(row) / rows).cast("long"))
    df = previous(df, [file], [row], {was: key}, piece, first)
    df = df.withColumn(step, (~F.col(first) & ~F.col(was).eqNullSafe(F.col(key))).cast("long"))
    return running_total(df, [file], [row], step, name, piece).drop(piece, was, step, first)
