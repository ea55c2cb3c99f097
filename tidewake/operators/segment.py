"""Segmentation into trips, and the gates that trips pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_NM, haversine
from ..functions.names import free
from . import scan

ORDER = ["ts_unix", "event_id"]


def ordered(key: list[str] | str, order: list[str] = ORDER) -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def running(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def gap_segments(df: DataFrame, key: str, gap_s: int = 1800, ts: str = "ts_unix", order: list[str] = ORDER, ranges: str | None = None) -> DataFrame:
    """seg: a new one begins where more than gap_s seconds pass.  ranges: a column of scan.with_ranges(), where a trajectory may be
    too long for a task."""
    was, split, first = free(df, "_was", "_split", "_first")
    if ranges:
        df = scan.previous(df, [key], order, {was: ts}, ranges, first).drop(first)
    else:
        df = df.withColumn(was, F.lag(ts).over(ordered(key, order)))
    df = df.withColumn(split, F.coalesce((F.col(ts) - F.col(was) > gap_s).cast("int"), F.lit(0)))
    return _summed(df, key, order, split, "seg", ranges).drop(was, split)


def label_segments(df: DataFrame, key: str, gap_s: int = 3600, ts: str = "ts_unix", order: list[str] = ORDER, ranges: str | None = None) -> DataFrame:
    """trip_idx: raised by a gap of gap_s or more, by an end label at a later row, and by a start label of the row before.
    ranges as in gap_segments."""
    labels = F.split(F.coalesce("annotation", F.lit("")), ";")
    has = lambda *names: F.arrays_overlap(labels, F.array(*map(F.lit, names))).cast("int")
    start, was, step, first = free(df, "_start", "_was", "_step", "_first")
    df = df.withColumn(start, has("STOP_START", "GAP_START"))
    before = F.struct(F.col(ts).alias("t"), F.col(start).alias("start"))
    if ranges:
        df = scan.previous(df.withColumn(step, before), [key], order, {was: step}, ranges, first)
    else:
        w = ordered(key, order)
        df = df.withColumns({was: F.lag(before).over(w), first: F.row_number().over(w) == 1})
    gap = F.coalesce((F.col(ts) - F.col(was)["t"] >= gap_s).cast("int"), F.lit(0))
    end = F.when(F.col(first), 0).otherwise(has("STOP_END", "GAP_END"))
    df = df.withColumn(step, gap + end + F.coalesce(F.col(was)["start"], F.lit(0)))
    return _summed(df, key, order, step, "trip_idx", ranges).drop(start, was, step, first)


def _summed(df: DataFrame, key: str, order: list[str], column: str, name: str, ranges: str | None) -> DataFrame:
    if ranges:
        return scan.running_total(df, [key], order, column, name, ranges)
    return df.withColumn(name, F.sum(column).over(running(ordered(key, order))))


def point_index(df: DataFrame, keys: list[str], order: list[str] = ORDER, ranges: str | None = None) -> DataFrame:
    """point_idx: the row's place in its trajectory, from 0.  ranges as in gap_segments; those of a longer key will do."""
    if not ranges:
        return df.withColumn("point_idx", F.row_number().over(ordered(keys, order)) - 1)
    (one,) = free(df, "_one")
    out = scan.running_total(df.withColumn(one, F.lit(1)), keys, order, one, "point_idx", ranges)
    return out.withColumn("point_idx", F.col("point_idx") - 1).drop(one)


def trip_id(prefix: str, key: Column, idx: Column) -> Column:
    return F.format_string(f"{prefix}_%d_%04d", key, idx)


def trip_gates(df: DataFrame, keys: list[str], min_points: int = 20, min_duration_s: int = 300, min_nm: float = 0.5, ts: str = "ts_unix") -> DataFrame:
    """keys, n, duration and displacement of the trips that pass."""
    order = F.struct(ts, "event_id")
    first, last = F.min_by(F.struct("lat", "lon"), order), F.max_by(F.struct("lat", "lon"), order)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(ts) - F.min(ts)).alias("duration_s"), first.alias("_a"), last.alias("_b"))
    nm = haversine(F.col("_a.lat"), F.col("_a.lon"), F.col("_b.lat"), F.col("_b.lon"), EARTH_NM)
    out = out.withColumn("displacement_nm", nm).drop("_a", "_b")
    return out.where((F.col("n") >= min_points) & (F.col("duration_s") >= min_duration_s) & (F.col("displacement_nm") >= min_nm))


def step_speed(w: Window, ts: str = "ts_unix") -> Column:
    """Metres a second from the row before; no time counts as a millisecond."""
    d = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    dt = (F.col(ts) - F.lag(ts).over(w)).cast("double")
    return d / F.when(dt <= 0, 1e-3).otherwise(dt)


def trajectory_gates(df: DataFrame, keys: list[str], min_points: int = 10, min_duration_s: int = 60, max_kmh: float = 180.0, min_displacement_m: float = 100.0) -> DataFrame:
    """keys, n, duration_s, max_kmh and diagonal_m of the trajectories that pass; the others are rejected whole."""
    rows = df.withColumn("_v", step_speed(ordered(keys)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max("ts_unix") - F.min("ts_unix")).alias("duration_s"), F.coalesce(F.max("_v") * 3.6, F.lit(0.0)).alias("max_kmh"),
        haversine(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).alias("diagonal_m"),
    )
    return out.where((F.col("n") >= min_points) & (F.col("duration_s") >= min_duration_s) & (F.col("max_kmh") <= max_kmh) & (F.col("diagonal_m") >= min_displacement_m))


def kept(df: DataFrame, passed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the keys that passed."""
    return df.join(passed.select(*keys), keys, "left_semi")


def manifest(df: DataFrame, keys: list[str], ts: str = "ts_unix") -> DataFrame:
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    return df.groupBy(*keys).agg(F.count("*").alias("n_points"), mid("lat").alias("lat_mid"), mid("lon").alias("lon_mid"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
