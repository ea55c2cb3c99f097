"""Sampling, splits, normalised sequences, masks, interpolation, errors and vocabularies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.names import guarded
from ..functions.scratch import few, settled


def grid_sample(manifest: DataFrame, key: str, n: int, grid: int = 20) -> DataFrame:
    """n trajectories, spread over the cells of a grid by lat_mid and lon_mid: n // cells each, one more for the densest
    n % cells; what small cells lack comes from the densest cells.  Within a cell the order is that of the key's md5."""
    lo = manifest.agg(F.min("lat_mid").alias("a0"), F.max("lat_mid").alias("a1"), F.min("lon_mid").alias("o0"), F.max("lon_mid").alias("o1"), F.count("*").alias("total"))
    rows = manifest.join(F.broadcast(lo))  # one row
    index = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / (F.col(b) - F.col(a) + 1e-9) * grid), F.lit(grid - 1))
    rows = rows.withColumn("cell", (index("lat_mid", "a0", "a1") * grid + index("lon_mid", "o0", "o1")).cast("long"))
    rows = rows.withColumn("_h", F.md5(F.col(key).cast("string").cast("binary")))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size"))  # at most grid * grid rows
    w, whole = Window.orderBy(F.desc("size"), "cell"), Window.partitionBy()
    sizes = sizes.withColumns({"place": F.row_number().over(w), "cells": F.count("*").over(whole)})
    quota = F.floor(F.lit(n) / F.col("cells")) + (F.col("place") <= F.lit(n) % F.col("cells")).cast("int")
    sizes = sizes.withColumn("quota", quota).withColumn("spare", F.greatest(F.col("size") - F.col("quota"), F.lit(0)))
    sizes = sizes.withColumns({"lacking": F.lit(n) - F.sum(F.least("size", "quota")).over(whole), "earlier": F.sum("spare").over(w) - F.col("spare")})
    rows = rows.join(F.broadcast(sizes), "cell")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("_h", key)))
    # a row beyond its cell's quota is the (earlier + what lies between)th spare one
    keep = (F.col("total") <= n) | (F.col("_r") <= F.col("quota")) | (F.col("earlier") + F.col("_r") - F.col("quota") <= F.col("lacking"))
    return rows.where(keep).select(key, "cell")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """_i (from 1) by the order, and _n, the number of rows, without bringing the rows into one partition: ranges of the
    order are numbered each for themselves, and the sums of their sizes, one row a range, added.

    The ranged rows are settled first: where a range ends may differ from one execution to the next, and both the sizes and
    the rows must see the same ranges."""
    in_range = F.monotonically_increasing_id()  # the partition's number times 2^33, and the row's place in it
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", in_range))
    ranged = ranged.withColumns({"_p": F.shiftright("_m", 33), "_own": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_m")
    sizes = ranged.groupBy("_p").agg(F.max("_own").alias("_size"))
    w = Window.orderBy("_p")
    sizes = sizes.select("_p", (F.sum("_size").over(w) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_n"))
    return ranged.join(F.broadcast(sizes), "_p").withColumn("_i", F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


BUCKET_ROWS = 100_000
SHIFTS = (40, 20, 0)  # the bits of a value's order that a pass leaves out


def ordered_bits(x: Column) -> Column:
    """A long for each double, in the order of the doubles: the bits of its magnitude, negative for negative values.  Both
    zeros are equal; NaN comes last."""
    a = F.abs(x)
    e = F.floor(F.log2(a))
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    e = F.least(e, F.lit(1023))
    share = lambda c: F.floor(c).cast("long")
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + share((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 52))
    size = F.when(a == float("inf"), F.lit(2047 << 52)).when(a < 2.0**-1022, share(a / 5e-324)).otherwise(normal)
    return F.when(F.isnan(x), F.lit((2047 << 52) + 1)).when(x < 0, -size).otherwise(size)


def percentiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float], sets: list[list[str]] | None = None, ready: bool = False) -> DataFrame:
    """A row a group (one of all rows, without ``by``): exact percentiles of the column, linear between ranks, nulls left out, NaN
    above all.  sets: several groupings by some of ``by``, the others null, and their number in _set.  ready: df is settled.

    Ranks are found by histograms that are refined, of the leading bits of the values' order: each pass counts only rows in the
    buckets that hold a rank, until those hold one value, or at most BUCKET_ROWS rows each, which are then sorted.  Rows are
    counted where they lie, for all groupings at once; what is shuffled are counts, and the rows of those last buckets."""
    x, k = "_x", "_k"
    of = [f"_g{i}" for i in range(len(by))]
    value = F.col(column).cast("double")
    rows = df.where(value.isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, of)), value.alias(x)).withColumn(k, ordered_bits(F.col(x)))
    rows = rows if ready else settled(rows)
    kinds = dict(rows.dtypes)
    groups = F.array(*(
        F.struct(F.lit(i).alias("_set"), *((F.col(g) if c in chosen else F.lit(None).cast(kinds[g])).alias(g) for c, g in zip(by, of))) for i, chosen in enumerate([by] if sets is None else sets)
    ))
    bounds = None  # of each group and rank wanted: the bucket it is in, and how many values come before that
    for shift, above in zip(SHIFTS, (None, *SHIFTS)):
        inside = rows
        if bounds is not None:
            inside = rows.join(few(bounds.select(F.col("bucket").alias("_in")).distinct()), F.shiftright(k, above) == F.col("_in"), "left_semi")
        bucket = F.shiftright(k, shift).alias("bucket")
        counted = inside.groupBy(*of, bucket).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        counted = counted.select(F.explode(groups).alias("g"), "bucket", "n", "low", "high").groupBy("g", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        w = Window.partitionBy("g").orderBy("bucket")
        if bounds is None:
            counted = counted.withColumn("upto", F.sum("n").over(w)).withColumn("size", F.sum("n").over(Window.partitionBy("g")))
            place = lambda p: (F.col("size") - 1) * F.lit(p)
            ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()))))
            ranks = F.filter(ranks, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
            found = counted.select("g", "bucket", "n", "size", "low", "high", (F.col("upto") - F.col("n")).alias("before"), F.explode(ranks).alias("rank"))
        else:
            wanted = bounds.select("g", F.col("bucket").alias("_in"), F.col("before").alias("_before"), "rank", "size")
            w = Window.partitionBy("g", "rank").orderBy("bucket")
            found = counted.withColumn("_in", F.shiftright("bucket", above - shift)).join(few(wanted), ["g", "_in"])
            found = found.withColumn("upto", F.col("_before") + F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
            found = found.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))).select("g", "bucket", "n", "size", "low", "high", "before", "rank")
        bounds = settled(found)
        if shift == 0:
            break
        most = bounds.where("low < high").agg(F.max("n")).first()[0]  # rows of the largest bucket that is not yet decided
        if most is None:
            break
        if most <= BUCKET_ROWS:
            bounds = _sorted_out(rows.join(few(bounds.select(F.col("bucket").alias("_in")).distinct()), F.shiftright(k, shift) == F.col("_in"), "left_semi"), bounds, groups, x, k, shift)
            break
    at = F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at")  # two ranks a percentile at most
    ranked = bounds.groupBy("g", "size").agg(at)

    def between(p: float) -> Column:
        place = (F.col("size") - 1) * F.lit(p)
        a, b = (F.element_at("at", f(place)) for f in (F.floor, F.ceil))
        return F.when((a == b) | (place == F.floor(place)), a).otherwise(a + (b - a) * (place - F.floor(place)))

    out = [between(p).alias(name) for name, p in shares.items()]
    return ranked.select(*([F.col("g._set").alias("_set")] if sets is not None else []), *(F.col("g")[g].alias(c) for c, g in zip(by, of)), *out)


def _sorted_out(inside: DataFrame, bounds: DataFrame, groups: Column, x: str, k: str, shift: int) -> DataFrame:
    """bounds, with the value of each rank as low: the rows of a group's bucket, at most BUCKET_ROWS where their values differ, are
    sorted; buckets of one value need none."""
    open_ = bounds.where("low < high").select("g", "bucket", "before").distinct()
    w = Window.partitionBy("g", "bucket").orderBy(k)
    each = inside.select(F.explode(groups).alias("g"), F.shiftright(k, shift).alias("bucket"), x, k).join(few(open_), ["g", "bucket"])
    each = each.select("g", F.col(x).alias("_value"), (F.col("before") + F.row_number().over(w) - 1).alias("rank"))
    found = bounds.join(each, ["g", "rank"], "left")
    return found.select("g", "size", "rank", F.coalesce("_value", "low").alias("low"))


@guarded
def chronological_split(starts: DataFrame, key: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """split of each trajectory by start_ts, then key: the whole part of n * train, of n * val, and the rest to test.  The shares count
    as the decimals they are written as: 0.7 of 170 is 119, which as a double is a little less."""
    rows = numbered(starts, "start_ts", key)
    a, b = (F.floor(F.col("_n") * F.lit(Decimal(str(share)))) for share in (train, val))
    return rows.withColumn("split", F.when(F.col("_i") <= a, "train").when(F.col("_i") <= a + b, "val").otherwise("test")).drop("_n", "_i")


@guarded
def normalised(df: DataFrame, key: str, ts: str = "ts_unix", order: list[str] | None = None) -> DataFrame:
    """x, y: offsets from the first point over the largest of them; tau: log1p of the step over the largest, or 1."""
    w = Window.partitionBy(key).orderBy(*(order or [ts, "event_id"]))
    whole = Window.partitionBy(key)
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_y": F.col("lat") - F.first("lat").over(all_rows), "_x": F.col("lon") - F.first("lon").over(all_rows), "_dt": F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lit(0))})
    half = F.greatest(F.max(F.greatest(F.abs("_y"), F.abs("_x"))).over(whole), F.lit(1e-8))
    most = F.max("_dt").over(whole)
    return df.withColumns({"y": F.col("_y") / half, "x": F.col("_x") / half, "tau": F.when(most > 0, F.log1p("_dt") / F.log1p(most)).otherwise(F.lit(1.0))}).drop("_y", "_x", "_dt")


@guarded
def last_n_mask(df: DataFrame, key: str, share: float = 0.15, order: list[str] | None = None) -> DataFrame:
    """masked: the last min(10, max(1, round(share * n))) rows, rounding half to even."""
    order = order or ["ts_unix", "event_id"]
    n = F.count("*").over(Window.partitionBy(key))
    back = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    k = F.least(F.lit(10), F.greatest(F.lit(1), F.bround(n * share, 0).cast("int")))
    return df.withColumn("masked", back <= k)


@guarded
def key_point_mask(df: DataFrame, key: str, share: float = 0.15, order: list[str] | None = None) -> DataFrame:
    """masked: the points farthest from the chord between the ends, ties with the last of them too; where the ends are one
    point, those farthest from it.  Trajectories of fewer than three points have none."""
    w = Window.partitionBy(key).orderBy(*(order or ["ts_unix", "event_id"])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_a": F.first(F.struct("lat", "lon")).over(w), "_b": F.last(F.struct("lat", "lon")).over(w), "_n": F.count("*").over(Window.partitionBy(key))})
    dy, dx = F.col("_b.lat") - F.col("_a.lat"), F.col("_b.lon") - F.col("_a.lon")
    y, x, chord = F.col("lat") - F.col("_a.lat"), F.col("lon") - F.col("_a.lon"), F.sqrt(dx * dx + dy * dy)
    off = F.when(chord < 1e-12, F.sqrt(x * x + y * y)).otherwise(F.abs(dx * y - dy * x) / chord)
    df = df.withColumn("_off", F.round(off, 9))
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0).cast("int"))
    far = F.rank().over(Window.partitionBy(key).orderBy(F.desc("_off"))) <= k
    return df.withColumn("masked", far & (F.col("_n") >= 3)).drop("_a", "_b", "_n", "_off")


@guarded
def interpolated(df: DataFrame, key: str, columns: tuple[str, ...] = ("lat", "lon"), order: list[str] | None = None) -> DataFrame:
    """<c>_hat of masked rows: linear by place between the visible neighbours; beyond the ends on from the last (or first)
    two visible rows; a copy if there is one."""
    w = Window.partitionBy(key).orderBy(*(order or ["ts_unix", "event_id"]))
    df = df.withColumn("_i", F.row_number().over(w))
    shown = F.when(~F.col("masked"), F.struct("_i", *columns))
    df = df.withColumn("_v", shown)
    seen = Window.partitionBy(key, "masked").orderBy("_i")
    df = df.withColumn("_two", F.when(~F.col("masked"), F.struct(F.col("_v").alias("one"), F.lag("_v").over(seen).alias("back"), F.lead("_v").over(seen).alias("on"))))
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumns({"_p": F.last("_two", ignorenulls=True).over(past), "_f": F.first("_two", ignorenulls=True).over(ahead)})
    out = {}
    for c in columns:
        line = lambda a, b, c=c: F.col(a)[c] + (F.col("_i") - F.col(a)["_i"]) * (F.col(b)[c] - F.col(a)[c]) / (F.col(b)["_i"] - F.col(a)["_i"])
        inner = line("_p.one", "_f.one")
        tail = F.coalesce(line("_p.one", "_p.back"), F.col("_p.one")[c])
        head = F.coalesce(line("_f.one", "_f.on"), F.col("_f.one")[c])
        out[f"{c}_hat"] = F.when(~F.col("masked"), F.col(c)).when(F.col("_p").isNotNull() & F.col("_f").isNotNull(), inner).when(F.col("_p").isNotNull(), tail).otherwise(head)
    return df.withColumns(out).drop("_i", "_v", "_two", "_p", "_f")


def errors(df: DataFrame, levels: list[str]) -> DataFrame:
    """n_points, mae, rmse, median and p90 of error_m, over all and by each of the levels.  Means are taken by all levels
    together and added up, so that rows are not repeated for each level."""
    n, total, squares = F.count("*"), F.sum("error_m"), F.sum(F.col("error_m") * F.col("error_m"))
    df = settled(df.where("error_m is not null").select(*levels, "error_m"))
    fine = df.groupBy(*levels).agg(n.alias("n"), total.alias("s"), squares.alias("q"))
    sets = [[], *([c] for c in levels)]
    kinds = dict(fine.dtypes)
    groups = F.array(*(F.struct(F.lit(i).alias("_set"), *((F.col(c) if c in chosen else F.lit(None).cast(kinds[c])).alias(c) for c in levels)) for i, chosen in enumerate(sets)))
    means = fine.select(F.explode(groups).alias("g"), "n", "s", "q").groupBy("g").agg(F.sum("n").alias("n_points"), (F.sum("s") / F.sum("n")).alias("mae_m"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse_m"))
    ranks = percentiles(df, levels, "error_m", {"median_m": 0.5, "p90_m": 0.9}, sets, ready=True)
    ranks = ranks.select(F.struct("_set", *levels).alias("g"), "median_m", "p90_m")
    return means.join(ranks, "g").select(*(F.col("g")[c].alias(c) for c in levels), "n_points", "mae_m", "rmse_m", "median_m", "p90_m")


def recovery_error(lat: Column, lon: Column, lat_hat: Column, lon_hat: Column) -> Column:
    return haversine(lat, lon, lat_hat, lon_hat)


def robust_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """center (median) and scale (half of the 16th to the 84th percentile, 1 where that is nothing) of each group."""
    p = percentiles(df, [group], column, {"center": 0.5, "_lo": 0.16, "_hi": 0.84})
    half = (F.col("_hi") - F.col("_lo")) / 2
    return p.select(group, "center", F.when(half < 1e-9, 1.0).otherwise(half).alias("scale"))


def vocabulary(df: DataFrame, cell: str, most: int = 50_000, least: int = 1) -> DataFrame:
    """cell, n and token: ids from 4 on, most frequent first, then by cell."""
    n = df.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = n.orderBy(F.desc("n"), cell).limit(most)
    return top.withColumn("token", F.row_number().over(Window.orderBy(F.desc("n"), cell)) + 3)


@guarded
def token_runs(df: DataFrame, key: str, token: str, order: list[str] | None = None) -> DataFrame:
    """The rows whose token differs from the row's before."""
    w = Window.partitionBy(key).orderBy(*(order or ["ts_unix", "event_id"]))
    before = F.lag(token).over(w)
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(token))).drop("_b")


MOST_COMPONENTS = 1024


def mean_pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, i and v: the mean of each component over the key's rows; null vectors count for nothing.  Components are averages of one
    aggregate, so a key is one row a task; vectors wider than MOST_COMPONENTS are dealt by component instead."""
    width = df.agg(F.max(F.size(vector))).first()[0] or 0
    if not 0 < width <= MOST_COMPONENTS:
        each = df.select(key, F.posexplode(vector).alias("i", "x"))
        return each.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(width)]
    pooled = df.where(F.col(vector).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.array(*means).alias("_v"), F.max(F.size(vector)).alias("_n"))
    return pooled.select(key, F.posexplode(F.slice("_v", 1, F.col("_n"))).alias("i", "v"))


def top_categories(counts: Column, n: int = 2) -> Column:
    """The n most frequent keys of a JSON object of counts, with spaces for underscores."""
    entries = F.map_entries(F.from_json(counts, "map<string,long>"))
    first = F.slice(F.array_sort(entries, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), 1, n)
    return F.transform(first, lambda x: F.replace(x["key"], F.lit("_"), F.lit(" ")))
