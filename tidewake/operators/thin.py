"""Sequential operators: what a row becomes depends on what was kept before it, so a trajectory runs in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.names import free, guarded


def _kept(df: DataFrame, keys: list[str], order: list[str], columns: list[str], keeps: Callable[[tuple, tuple | None], bool]) -> DataFrame:
    """The rows that ``keeps`` keeps, asked with a row's columns (as doubles) and those of the last row kept, None before.

    Trajectories lie one after another in sorted partitions and are streamed by batches; all that is carried on is one row,
    so a trajectory of any length fits.  Nulls in the order come last; null keys are one trajectory."""
    name = "_" * (1 + max(map(len, df.columns))) + "new"  # no column has this name
    by = [F.col(c).asc_nulls_last() for c in order]
    starts = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) == 1
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            values = [b.column(c).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).tolist() for c in columns]
            keep = []
            for new, *row in zip(b.column(name).to_pylist(), *values):
                last = None if new else last
                keep.append(keeps(tuple(row), last))
                last = tuple(row) if keep[-1] else last
            yield b.filter(pa.array(keep, pa.bool_())).select(names)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *by)
    return placed.withColumn(name, starts).mapInArrow(run, df.schema)


def greedy_thin(df: DataFrame, keys: list[str], every_s: float, ts: str = "ts_unix", order: list[str] | None = None) -> DataFrame:
    """Keeps a row if every_s have passed since the last one kept."""

    def keeps(row: tuple, last: tuple | None) -> bool:
        return row[0] - (-math.inf if last is None else last[0]) >= every_s

    return _kept(df, keys, order or [ts, "event_id"], [ts], keeps)


def denoise(df: DataFrame, keys: list[str], max_ms: float = 55.0, ts: str = "ts_unix", order: list[str] | None = None) -> DataFrame:
    """Keeps a row if it is reached from the last one kept in some time and at no more than max_ms; the first always."""

    def keeps(row: tuple, last: tuple | None) -> bool:
        if last is None:
            return True
        t, (lat, lon) = row[0] - last[0], map(math.radians, row[1:])
        lat0, lon0 = map(math.radians, last[1:])
        h = math.sin((lat - lat0) / 2) ** 2 + math.cos(lat) * math.cos(lat0) * math.sin((lon - lon0) / 2) ** 2
        return t != 0 and not 2 * 6_371_000.0 * math.asin(math.sqrt(min(1.0, h))) / t > max_ms

    return _kept(df, keys, order or [ts, "event_id"], [ts, "lat", "lon"], keeps)


def kalman_smoothed(df: DataFrame, keys: list[str], q: float = 1e-4, r: float = 1e-4, order: list[str] | None = None) -> DataFrame:
    """lat_s and lon_s: constant-velocity Kalman filter over the row's place in its trajectory, then the Rauch-Tung-Striebel
    pass back.  A null or NaN position is a missing observation; a trajectory without any has nulls.

    The filter starts at the first position seen, at rest, with covariance one, and predicts before each row, the first too.
    Latitude and longitude share one covariance of position and velocity.  A forward pass over sorted partitions stores the
    filter's states beside the rows, and a backward pass goes over the same partitions in reverse; each carries one row."""
    by = [F.col(c) for c in order or ["ts_unix", "event_id"]]
    new, end, state = free(df, "_new", "_end", "_state")
    names = df.columns
    w = Window.partitionBy(*keys)
    starts = F.row_number().over(w.orderBy(*(c.asc_nulls_last() for c in by))) == 1
    seen = lambda t: [t.column(c).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).tolist() for c in ("lat", "lon")]
    known = lambda v: v is not None and v == v

    def predicted(s: tuple) -> tuple:
        x, y, u, v, a, b, c = s
        return (x + u, y + v, u, v, a + 2 * b + c + q, b + c, c + q)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, started = None, False
        for t in batches:
            out = []
            for first, lat, lon in zip(t.column(new).to_pylist(), *seen(t)):
                if first:
                    s, started = (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0), False
                here = known(lat) and known(lon)
                if here and not started:  # rows before it are predicted to be where it is; the pass back puts them there
                    s, started = (lat, lon, 0.0, 0.0, *s[4:]), True
                x, y, u, v, a, b, c = predicted(s)
                if here:
                    k, g = a / (a + r), b / (a + r)
                    dx, dy = lat - x, lon - y
                    x, y, u, v, a, b, c = x + k * dx, y + k * dy, u + g * dx, v + g * dy, (1 - k) * a, (1 - k) * b, c - g * b
                s = (x, y, u, v, a, b, c)
                out.append([float(started), *s])
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, state])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, place = None, None  # the smoothed state of the row after, and the first position seen in what is left
        for t in batches:
            lats, lons = [], []
            for last, s, lat, lon in zip(t.column(end).to_pylist(), t.column(state).to_pylist(), *seen(t)):
                started, s = s[0], tuple(s[1:])
                if last:
                    later, place = None, None
                if not started:
                    s = None if place is None else (*place, 0.0, 0.0, *s[4:])
                elif known(lat) and known(lon):
                    place = (lat, lon)
                if s is not None and later is not None:
                    px, py, pu, pv, pa_, pb, pc = predicted(s)
                    x, y, u, v, a, b, c = s
                    det = pa_ * pc - pb * pb
                    # C = P F' inv(P of the prediction)
                    xx, xv = ((a + b) * pc - b * pb) / det, (b * pa_ - (a + b) * pb) / det
                    vx, vv = ((b + c) * pc - c * pb) / det, (c * pa_ - (b + c) * pb) / det
                    dx, dy, du, dv = later[0] - px, later[1] - py, later[2] - pu, later[3] - pv
                    s = (x + xx * dx + xv * du, y + xx * dy + xv * dv, u + vx * dx + vv * du, v + vx * dy + vv * dv, a, b, c)
                later = s
                lats.append(None if s is None else s[0])
                lons.append(None if s is None else s[1])
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array(lats, pa.float64()), pa.array(lons, pa.float64())], names=[*names, "lat_s", "lon_s"])

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *(c.asc_nulls_last() for c in by)).withColumn(new, starts)
    filtered = placed.mapInArrow(forward, StructType([*df.schema.fields, StructField(state, ArrayType(DoubleType()))]))
    # Partitions stay as they are: a trajectory is whole in one of them, and only their order is turned around.
    turned = filtered.withColumn(end, F.monotonically_increasing_id()).sortWithinPartitions(F.desc(end))
    changed = lambda a, b: any(not (x is None and y is None) and x != y for x, y in zip(a, b))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In place of the row's number, whether it is the last of its trajectory (the first here)."""
        before = None
        for t in batches:
            ids, out = list(zip(*(t.column(k).to_pylist() for k in keys))), []
            for i in ids:
                out.append(before is None or changed(i, before))
                before = i
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in (*names, state)), pa.array(out, pa.bool_())], names=[*names, state, end])

    return turned.mapInArrow(lambda batches: backward(ended(batches)), StructType([*df.schema.fields, StructField("lat_s", DoubleType()), StructField("lon_s", DoubleType())]))


@guarded
def subsampled(df: DataFrame, keys: list[str], most: int, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """At most ``most`` rows a trajectory: row i stays with probability 1 for i <= 10, then falling with log(i - 9); the
    draw is a hash of seed, key and place, and the result is topped up or cut, by the draw's order, to exactly ``most``."""
    w = Window.partitionBy(*keys).orderBy(*(order or ["ts_unix", "event_id"]))
    whole = Window.partitionBy(*keys)
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    p = F.when(F.col("_i") <= 10, 1.0).otherwise(1 - (1 - most / F.col("_n")) * F.log(F.greatest(F.col("_i") - 9, F.lit(1))) / F.log(F.greatest(F.col("_n") - 9, F.lit(2))))
    text = F.concat_ws("|", F.lit(str(seed)), *keys, F.col("_i"))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    df = df.withColumn("_excess", draw - p)
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_excess", "_i")))
    return df.where(F.col("_r") <= most).drop("_i", "_n", "_excess", "_r")
