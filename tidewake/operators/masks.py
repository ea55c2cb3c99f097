"""Masks, corruptions, prefixes and extents for training tasks.

Draws are hashes of the seed and a row's keys, so that they come out alike however the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import from_mercator, mercator
from ..functions.names import guarded
from . import tasks

ORDER = ["ts_unix", "event_id"]
MODES = {"spatial_random": 0.30, "block": 0.15, "key_point": 0.15, "kinematic_group": 0.05, "semantic_group": 0.05, "last_n": 0.30}


def draw(*keys: Column | str | int) -> Column:
    """From 0 to below 1: a hash of the keys."""
    text = F.concat_ws("|", *(k if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _placed(df: DataFrame, key: str, order: list[str] | None) -> DataFrame:
    w = Window.partitionBy(key)
    return df.withColumns({"_i": F.row_number().over(w.orderBy(*(order or ORDER))) - 1, "_n": F.count("*").over(w)})


def _share(share: float | Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0).cast("int"))


@guarded
def random_mask(df: DataFrame, key: str, share: float = 0.5, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """masked: max(1, round(share * n)) rows of each trajectory, by the order of their draws."""
    df = _placed(df, key, order).withColumn("_draw", draw(seed, F.col(key), F.col("_i")))
    first = F.row_number().over(Window.partitionBy(key).orderBy("_draw", "_i"))
    return df.withColumn("masked", first <= _share(share)).drop("_i", "_n", "_draw")


@guarded
def block_mask(df: DataFrame, key: str, least: float = 0.20, most: float = 0.30, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """masked: one run of rows, a share between least and most of the trajectory, anywhere in it."""
    size = _share(F.lit(least) + (most - least) * draw(seed, "size", F.col(key)))
    df = _placed(df, key, order).withColumn("_size", size)
    start = F.floor(draw(seed, "start", F.col(key)) * F.greatest(F.lit(1), F.col("_n") - F.col("_size") + 1))
    return df.withColumn("masked", (F.col("_i") >= start) & (F.col("_i") < start + F.col("_size"))).drop("_i", "_n", "_size")


def mode_of(key: Column, seed: int = 42, modes: dict[str, float] = MODES) -> Column:
    """A trajectory's way of masking, drawn with the given probabilities."""
    x, upto, out = draw(seed, "mode", key), 0.0, F
    for name, p in modes.items():
        upto += p
        out = out.when(x < upto, name)
    return out.otherwise(list(modes)[-1])


def masked(df: DataFrame, key: str, mode: Column, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """masked by each trajectory's mode.  Trajectories of fewer than three rows have no key points: 15 % at random."""
    ways = {
        "_half": lambda d: random_mask(d, key, 0.5, seed, order),
        "_few": lambda d: random_mask(d, key, 0.15, seed, order),
        "_block": lambda d: block_mask(d, key, seed=seed, order=order),
        "_key": lambda d: tasks.key_point_mask(d, key, order=order),
        "_last": lambda d: tasks.last_n_mask(d, key, order=order),
    }
    df = df.withColumn("_mode", mode)
    for name, way in ways.items():
        df = way(df).withColumnRenamed("masked", name)
    few = F.count("*").over(Window.partitionBy(key)) < 3
    chosen = F.when(F.col("_mode") == "block", F.col("_block")).when(F.col("_mode") == "last_n", F.col("_last"))
    chosen = chosen.when(F.col("_mode") == "key_point", F.when(few, F.col("_few")).otherwise(F.col("_key"))).otherwise(F.col("_half"))
    return df.withColumn("masked", chosen).drop("_mode", *ways)


@guarded
def downsampled(df: DataFrame, key: str, rate: float = 0.3, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """Rows between a trajectory's ends go with probability rate; the ends stay."""
    df = _placed(df, key, order)
    ends = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)
    return df.where(ends | (draw(seed, F.col(key), F.col("_i")) > rate)).drop("_i", "_n")


@guarded
def jittered(df: DataFrame, key: str, rate: float = 0.3, radius: float = 50.0, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """With probability rate a row's lat and lon move by radius metres of the Mercator plane, in a drawn direction."""
    df = _placed(df, key, order)
    of = lambda what: draw(seed, what, F.col(key), F.col("_i"))
    dx, dy = 2 * of("x") - 1, 2 * of("y") - 1
    norm = F.sqrt(dx * dx + dy * dy)
    norm = F.when(norm > 0, norm).otherwise(1.0)
    x, y = mercator(F.col("lat"), F.col("lon"))
    lat, lon = from_mercator(x + dx * radius / norm, y + dy * radius / norm)
    hit = of("move") <= rate
    return df.withColumns({"lat": F.when(hit, lat).otherwise(F.col("lat")), "lon": F.when(hit, lon).otherwise(F.col("lon"))}).drop("_i", "_n")


def prefixes(df: DataFrame, key: str, token: str, target: list[str], order: list[str] | None = None) -> DataFrame:
    """key, tokens of the visible rows (a token that repeats the one before it left out) and targets, the masked rows'
    columns, both in order; of trajectories with two visible rows, two tokens and a masked row at least."""
    order = order or ORDER
    w = Window.partitionBy(key, "masked").orderBy(*order)
    before = F.lag(token).over(w)
    new = F.row_number().over(w).eqNullSafe(F.lit(1)) | ~before.eqNullSafe(F.col(token))
    df = df.withColumn("_new", new & ~F.col("masked"))
    listed = lambda on, *cols: F.array_sort(F.collect_list(F.when(on, F.struct(*order, *(F.col(c).alias(f"_{c}") for c in cols)))))
    out = df.groupBy(key).agg(listed(F.col("_new"), token).alias("a"), listed(F.col("masked"), *target).alias("b"), F.count_if(~F.col("masked")).alias("visible"))
    out = out.where((F.col("visible") >= 2) & (F.size("a") >= 2) & (F.size("b") >= 1))
    targets = F.transform("b", lambda x: F.struct(*(x[f"_{c}"].alias(c) for c in target)))
    return out.select(key, F.transform("a", lambda x: x[f"_{token}"]).alias("tokens"), targets.alias("targets"))


@guarded
def within_length(df: DataFrame, key: str, most: int = 200) -> DataFrame:
    """The trajectories of at most ``most`` rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") <= most).drop("_n")


def extent(df: DataFrame, x: str = "x", y: str = "y", clip_pct: float = 0.0, buffer: float = 500.0) -> DataFrame:
    """One row x_min, y_min, x_max, y_max: the points' box, or that of the percentiles clip_pct and 100 - clip_pct, and a buffer."""
    if clip_pct > 0:
        p = clip_pct / 100
        box = tasks.percentiles(df, [], x, {"x_min": p, "x_max": 1 - p}).crossJoin(tasks.percentiles(df, [], y, {"y_min": p, "y_max": 1 - p}))  # one row each
    else:
        box = df.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))
    return box.select(*((F.col(c) - buffer).alias(c) for c in ("x_min", "y_min")), *((F.col(c) + buffer).alias(c) for c in ("x_max", "y_max")))
