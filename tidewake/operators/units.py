"""Frozen units of trajectories for evaluation, and records of predictions on them.

A unit is a dataset of a domain in a split.  Units are folders of Parquet; a manifest, a row a unit, holds their counts and
checksums.  What is there and whole is not written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import free
from ..functions.scalars import denormalised
from ..functions.scratch import few, settled
from . import masks, tasks, thin

BY = ("split", "domain", "dataset")


def frozen(points: DataFrame, key: str, keep: tuple[str, ...] = (), max_len: int = 200, recovery: float = 0.5, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """A row a trajectory: key, the columns of keep (of its first row), traj_len, lat0, lon0, t0, bbox_half, log_max_dt, and arrays in order: x, y
    and tau (normalised), recovery and prediction (masks), of at most max_len rows, the others drawn away.

    points have lat, lon, ts_unix and event_id.  An array holds max_len values at most, so a trajectory of any length fits."""
    order = order or masks.ORDER
    columns = [key, *keep, *dict.fromkeys([*order, "lat", "lon", "ts_unix"])]
    rows = thin.subsampled(points.select(*dict.fromkeys(columns)), [key], max_len, seed, order)
    rows = tasks.normalised(rows, key, order=order)
    rows = masks.random_mask(rows, key, recovery, seed, order).withColumnRenamed("masked", "_recovery")
    rows = tasks.last_n_mask(rows, key, order=order).withColumnRenamed("masked", "_prediction")
    listed = F.array_sort(F.collect_list(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in ("lat", "lon", "ts_unix", *keep)), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("tau").alias("_tau"), "_recovery", "_prediction")))
    rows = rows.groupBy(key).agg(listed.alias("r"))
    first = lambda c: F.get("r", F.lit(0))[c]
    each = lambda c: F.transform("r", lambda p: p[c])
    far = F.array_max(F.transform("r", lambda p: F.greatest(F.abs(p["_lat"] - F.get("r", F.lit(0))["_lat"]), F.abs(p["_lon"] - F.get("r", F.lit(0))["_lon"]))))
    steps = F.transform("r", lambda p, i: F.when(i > 0, p["_ts_unix"] - F.get("r", i - 1)["_ts_unix"]).otherwise(0))
    most = F.greatest(F.array_max(steps), F.lit(0))
    return rows.select(
        key, *(first(f"_{c}").alias(c) for c in keep), F.size("r").alias("traj_len"), first("_lat").alias("lat0"), first("_lon").alias("lon0"), first("_ts_unix").alias("t0"),
        F.greatest(far, F.lit(1e-8)).alias("bbox_half"), F.log1p(most.cast("double")).alias("log_max_dt"),
        each("_x").alias("x"), each("_y").alias("y"), each("_tau").alias("tau"), each("_recovery").alias("recovery"), each("_prediction").alias("prediction"),
    )


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, by: tuple[str, ...]) -> DataFrame:
    """Parquet in folders of ``by``, whose values are text whatever they look like."""
    rows = spark.read.parquet(path)
    return rows.select(*(c for c in rows.columns if c not in by), *(F.col(c).cast("string").alias(c) for c in by))


def _summed(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row a unit: how many rows it has, and a checksum that does not depend on their order."""
    values = sorted(c for c in rows.columns if c not in by)
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*values)).alias("checksum"))


def manifest(spark: SparkSession, root: str, by: tuple[str, ...] = BY) -> DataFrame | None:
    """The units that were written: by, n_rows and checksum as they were last."""
    if not _there(spark, f"{root}/manifest"):
        return None
    last = F.max_by(F.struct("n_rows", "checksum"), "written").alias("m")
    return spark.read.parquet(f"{root}/manifest").groupBy(*by).agg(last).select(*by, "m.*")


def whole(spark: SparkSession, root: str, by: tuple[str, ...] = BY) -> DataFrame | None:
    """The manifest's units whose files have the counts and checksums written there."""
    known = manifest(spark, root, by)
    if known is None or not _there(spark, f"{root}/data"):
        return None
    return known.join(_summed(_read(spark, f"{root}/data", by), by), [*by, "n_rows", "checksum"], "left_semi")


def freeze(rows: DataFrame, root: str, by: tuple[str, ...] = BY, overwrite: bool = False, verify: bool = True) -> DataFrame:
    """Writes the units of rows that are not yet there under root, and returns its manifest.

    by are text columns, not null.  A unit that is in the manifest is left as it is, unless overwrite is set or (with verify, which reads
    the files) its files are not what the manifest says.  Each unit is replaced as a whole, and enters the manifest after its files
    are complete: a run that dies is made good by the next one."""
    spark = rows.sparkSession
    rows = rows.select(*(c for c in rows.columns if c not in by), *(F.col(c).cast("string").alias(c) for c in by))
    done = None if overwrite else whole(spark, root, by) if verify else manifest(spark, root, by)
    todo = rows.select(*by).distinct()
    if done is not None:
        todo = todo.join(done, list(by), "left_anti")
    todo = settled(todo)
    if not todo.isEmpty():
        new = rows if done is None else rows.join(few(todo), list(by), "left_semi")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/data")
        found = _summed(_read(spark, f"{root}/data", by).join(few(todo), list(by), "left_semi"), by)
        found.withColumn("written", F.lit(_now(spark))).write.mode("append").parquet(f"{root}/manifest")
    return manifest(spark, root, by)


def _now(spark: SparkSession) -> int:
    return spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]


def units(spark: SparkSession, root: str, by: tuple[str, ...] = BY, **values: str | list[str] | None) -> DataFrame:
    """The rows of the units under root with the given values (one or several) of split, domain or dataset; only their folders
    are read."""
    rows = spark.read.parquet(f"{root}/data")
    for c, v in values.items():
        if v is not None:
            rows = rows.where(F.col(c).isin([v] if isinstance(v, str) else list(v)))
    return rows


def ordinals(rows: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """rows with their place (from 0) in their group by order, unique.  All rows are numbered together, in ranges, and each group's
    first number taken off, so a group of most rows is in many tasks."""
    (first,) = free(rows, "_group")
    i, n = "_i", "_n"
    placed = tasks.numbered(rows, group, *order).drop(n)
    low = placed.groupBy(F.col(group).alias(first)).agg(F.min(i).alias("_low"))
    return placed.join(few(low), F.col(group).eqNullSafe(F.col(first)), "left").withColumn(name, F.col(i) - F.col("_low")).drop(i, "_low", first)


def records(frozen_units: DataFrame, predicted: DataFrame, key: str, mask: str = "prediction", max_len: int | None = 200) -> DataFrame:
    """A row a trajectory with hidden rows: uid (dataset#place in it), key, domain, dataset, traj_len, and arrays of its hidden rows: at, true_lat,
    true_lon, pred_lat, pred_lon and err_m.

    predicted has key and the arrays pred_x and pred_y, normalised as the unit's.  Trajectories longer than max_len, or without
    a hidden row, are left out, but keep their place in the dataset."""
    rows = ordinals(frozen_units, "dataset", [key]).join(predicted.select(key, "pred_x", "pred_y"), key)
    hidden = F.filter(F.sequence(F.lit(0), F.col("traj_len") - 1), lambda i: F.get(mask, i))
    rows = rows.withColumn("at", hidden).where(F.size("at") > 0)
    if max_len is not None:
        rows = rows.where(F.col("traj_len") <= max_len)

    def real(y: str, x: str, which: int) -> Column:
        return F.transform("at", lambda i: denormalised(F.get(y, i), F.get(x, i), F.col("bbox_half"), F.col("lat0"), F.col("lon0"))[which])

    rows = rows.withColumns({"true_lat": real("y", "x", 0), "true_lon": real("y", "x", 1), "pred_lat": real("pred_y", "pred_x", 0), "pred_lon": real("pred_y", "pred_x", 1)})
    of = lambda c, i: F.get(c, i)
    err = F.transform(F.sequence(F.lit(0), F.size("at") - 1), lambda i: tasks.recovery_error(of("true_lat", i), of("true_lon", i), of("pred_lat", i), of("pred_lon", i)))
    uid = F.concat(F.col("dataset").cast("string"), F.lit("#"), F.col("ordinal").cast("string"))
    return rows.select(uid.alias("uid"), key, "domain", "dataset", "traj_len", "at", "true_lat", "true_lon", "pred_lat", "pred_lon", err.alias("err_m"))


def hidden(frozen_units: DataFrame, key: str, mask: str = "prediction") -> DataFrame:
    """key, at (the places of a trajectory's hidden rows) and their x, y and tau, gathered into arrays; empty where none is hidden."""
    at = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    rows = frozen_units.withColumn("_at", at)
    of = lambda c: F.transform("_at", lambda i: F.get(c, i)).alias(c)
    return rows.select(key, F.col("_at").alias("at"), of("x"), of("y"), of("tau"))


def standardised(frozen_units: DataFrame, key: str, mask: str = "prediction", max_len: int | None = 200, clamp_s: float | None = 15.0) -> DataFrame:
    """A row a trajectory, as a model of offsets takes it: uid (dataset#place in it), key, domain, dataset, traj_len, at (its hidden rows), and arrays
    lon_n and lat_n (offsets from its first row, less the dataset's median, over half of its 16th to 84th percentile) and dt (seconds
    from the row before, between 0 and clamp_s); besides lon0, lat0 and the dataset's lon_center, lon_scale, lat_center and lat_scale, which restored()
    takes.

    Trajectories longer than max_len, or with no row or every row hidden, are left out, but keep their place; the statistics are of
    those that stay."""
    rows = ordinals(frozen_units, "dataset", [key])
    at = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at).where((F.size("at") > 0) & (F.size("at") < F.col("traj_len")))
    if max_len is not None:
        rows = rows.where(F.col("traj_len") <= max_len)
    moved = lambda c: F.transform(c, lambda v: v * F.col("bbox_half"))
    seconds = lambda t: F.expm1(t * F.col("log_max_dt"))
    step = (lambda t: seconds(t)) if clamp_s is None else (lambda t: F.greatest(F.lit(0.0), F.least(F.lit(clamp_s), seconds(t))))
    rows = settled(rows.select(F.concat(F.col("dataset").cast("string"), F.lit("#"), F.col("ordinal").cast("string")).alias("uid"), key, "domain", "dataset", "traj_len", "at", "lat0", "lon0", moved("x").alias("dlon"), moved("y").alias("dlat"), F.transform("tau", step).alias("dt")))
    each = rows.select("dataset", F.explode(F.arrays_zip("dlon", "dlat")).alias("p")).select("dataset", F.explode(F.create_map(F.lit("lon"), F.col("p.dlon"), F.lit("lat"), F.col("p.dlat"))).alias("axis", "v"))
    stats = tasks.percentiles(each, ["dataset", "axis"], "v", {"center": 0.5, "lo": 0.16, "hi": 0.84})
    half = (F.col("hi") - F.col("lo")) / 2
    stats = stats.select("dataset", "axis", "center", F.when(half < 1e-9, 1.0).otherwise(half).alias("scale"))
    of = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{a}_{c}")
    stats = stats.groupBy("dataset").agg(*(of(a, c) for a in ("lon", "lat") for c in ("center", "scale")))
    rows = rows.join(few(settled(stats)), "dataset")
    scaled = lambda a: F.transform(f"d{a}", lambda v: (v - F.col(f"{a}_center")) / F.col(f"{a}_scale")).alias(f"{a}_n")
    return rows.select("uid", key, "domain", "dataset", "traj_len", "at", scaled("lon"), scaled("lat"), "dt", "lon0", "lat0", "lon_center", "lon_scale", "lat_center", "lat_scale")


def restored(lon_n: Column, lat_n: Column) -> tuple[Column, Column]:
    """lat and lon of values standardised as standardised() has them, with its columns at hand."""
    return lat_n * F.col("lat_scale") + F.col("lat_center") + F.col("lat0"), lon_n * F.col("lon_scale") + F.col("lon_center") + F.col("lon0")
