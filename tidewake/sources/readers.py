"""Readers of raw logs, each to the canonical columns trajectory_id (or its key), lat, lon and timestamp.

A reader parses; gap segmentation and the quality gates are operators, applied after it.  Lines that do not parse are
left out.  Paths may be globs or folders; all are read by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import context, resample, scan, segment, thin

# The columns of both AIS formats that are not text.
AIS_TYPES = {
    "long": ["MMSI"], "double": ["Latitude", "Longitude", "ROT", "SOG", "COG", "Heading", "Width", "Length", "Draught", "LAT", "LON", "Draft"],
    "int": ["Status", "VesselType", "Cargo"],
}
PNEUMA_EVERY = 25
PNEUMA_MODES = {"Car": "car", "Taxi": "taxi", "Bus": "bus", "Motorcycle": "motorcycle", "Medium Vehicle": "truck", "Heavy Vehicle": "truck"}


def _seconds(text: Column, fmt: str, zone: str | None = None) -> Column:
    """Epoch seconds of a time, in UTC or in a zone; null where it does not parse.  The session's zone plays no part."""
    t = F.try_to_timestamp(text, F.lit(fmt))
    if zone:
        t = F.to_utc_timestamp(t, zone)
    return _wall(t)


def _wall(t: Column) -> Column:
    """Seconds from 1970 to the date and time that t shows."""
    whole = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return whole + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def as_epoch(df: DataFrame, column: str, fmt: str) -> Column:
    """Epoch seconds by the column's type: whole numbers as they are, times converted, text parsed (null where it is not one)."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("long")
    if kind == "timestamp":
        return F.unix_seconds(column)
    return _wall(F.col(column)) if kind == "timestamp_ntz" else _seconds(F.col(column), fmt)


def _stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def ais_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header CSV.  Without a schema the header's names have the types of AIS_TYPES, or are text: only its line is read for that, and
    nothing is inferred.  Files have one header.  A value that is none of its type is null."""
    if schema is None:
        header = spark.read.text(path).first()
        names = [] if header is None else [c.strip().strip('"') for c in header[0].split(",")]
        kinds = {c: kind for kind, columns in AIS_TYPES.items() for c in columns}
        schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names)
    return spark.read.schema(schema).option("header", True).csv(path)


def annotated_csv(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited with a header that is replaced."""
    schema = "mmsi long, lon double, lat double, ts_unix long, computed_speed_kn double, computed_heading_deg double, annotation string"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", " ").csv(path)


def polylines(rows: DataFrame, key: Column, start: Column, line: Column, step: int = 15, prefix: str = "porto_") -> DataFrame:
    """A JSON list of [lon, lat] per trip to points ``step`` seconds apart; trips that do not parse or have less than two
    points are left out."""
    at = F.from_json(line, "array<array<double>>")
    rows = rows.select(key.alias("key"), start.cast("long").alias("start"), at.alias("at")).where(F.size("at") >= 2)
    each = rows.select("key", "start", F.posexplode("at").alias("i", "p"))
    return each.select(
        F.concat(F.lit(prefix), F.col("key").cast("string")).alias("trajectory_id"), F.col("i").alias("point_idx"),
        F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lon"), (F.col("start") + step * F.col("i")).cast("long").alias("timestamp"),
    )


def porto(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("escape", '"').csv(path).where(F.lower("MISSING_DATA") == "false")
    return polylines(rows, F.col("TRIP_ID"), F.col("TIMESTAMP"), F.col("POLYLINE"))


def pneuma(spark: SparkSession, path: str) -> DataFrame:
    """Rows of 4 fields and 6 per observation, every 25th of which is taken; the base time is in the file's name."""
    line = F.split(F.regexp_replace("value", r"\s", ""), ";")
    rows = spark.read.text(path).select(_stem().alias("stem"), line.alias("f")).where((F.size("f") >= 10) & ~F.get("f", F.lit(0)).rlike("track"))
    n = F.floor((F.size("f") - 4) / 6).cast("int")
    i = F.explode(F.sequence(F.lit(0), n - 1, F.lit(PNEUMA_EVERY)))
    day = F.regexp_extract("stem", r"(\d{8})_d\d+_(\d{4})", 1)
    base = F.coalesce(_seconds(F.concat_ws("", F.nullif(day, F.lit("")), F.regexp_extract("stem", r"(\d{8})_d\d+_(\d{4})", 2)), "yyyyMMddHHmm", "Europe/Athens"), F.lit(1540359000))
    field = lambda k: F.get("f", 4 + 6 * F.col("i") + k)
    mode = F.lit("car")
    for kind, label in PNEUMA_MODES.items():
        mode = F.when(F.get("f", F.lit(1)) == kind.replace(" ", ""), label).otherwise(mode)
    return rows.select("*", i.alias("i"), base.alias("base"), mode.alias("mode")).select(
        F.concat(F.lit("pneuma_"), "stem", F.lit("_"), F.get("f", F.lit(0))).alias("trajectory_id"), field(0).try_cast("double").alias("lat"), field(1).try_cast("double").alias("lon"),
        (F.col("base") + F.bround(field(5).try_cast("double"), 0)).cast("long").alias("timestamp"), F.col("mode").alias("transport_mode"),
    )


def tdrive(spark: SparkSession, path: str) -> DataFrame:
    """Headless id,time,lon,lat in UTC+8, within Beijing's box."""
    f = F.split("value", ",")
    rows = spark.read.text(path).select(_stem().alias("key"), f.alias("f")).where(F.size("f") == 4)
    out = rows.select("key", F.get("f", F.lit(3)).try_cast("double").alias("lat"), F.get("f", F.lit(2)).try_cast("double").alias("lon"), (_seconds(F.get("f", F.lit(1)), "yyyy-MM-dd HH:mm:ss") - 28800).alias("timestamp"))
    return out.where("timestamp is not null and lat between 38 and 41.5 and lon between 115 and 118")


def geolife(spark: SparkSession, path: str) -> DataFrame:
    """key, user, stem, line (the order of lines), lat, lon and timestamp of .plt lines of at least 7 fields; headers do not parse and so
    go.  The user is the folder above that of the file."""
    f = F.split("value", ",")
    name = F.input_file_name()
    rows = spark.read.text(path).select(F.regexp_extract(name, r"/([^/]+)/[^/]+/[^/]+$", 1).alias("user"), _stem().alias("stem"), F.monotonically_increasing_id().alias("line"), f.alias("f")).where(F.size("f") >= 7)
    time = F.concat_ws(" ", F.get("f", F.lit(5)), F.get("f", F.lit(6)))
    out = rows.select(F.concat_ws("_", "user", "stem").alias("key"), "user", "stem", "line", F.get("f", F.lit(0)).try_cast("double").alias("lat"), F.get("f", F.lit(1)).try_cast("double").alias("lon"), _seconds(time, "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return out.where("timestamp is not null and lat is not null and lon is not null")


def geolife_labels(spark: SparkSession, path: str) -> DataFrame:
    """user, t0, t1, label and label_order (the order of lines) of the users' label files: begin, end and mode, parted by tabs."""
    f = F.split(F.trim("value"), "\t")
    user = F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1)
    rows = spark.read.text(path).select(user.alias("user"), F.monotonically_increasing_id().alias("label_order"), f.alias("f")).where(F.size("f") == 3)
    at = lambda i: _seconds(F.get("f", F.lit(i)), "yyyy/MM/dd HH:mm:ss")
    return rows.select("user", at(0).alias("t0"), at(1).alias("t1"), F.trim(F.get("f", F.lit(2))).alias("label"), "label_order").where("t0 is not null and t1 is not null")


GEOLIFE_BOX = (38.5, 41.5, 114.5, 118.5)


def geolife_trips(points: DataFrame, labels: DataFrame, gap_s: int = 1800, box: tuple[float, float, float, float] = GEOLIFE_BOX) -> DataFrame:
    """trajectory_id, point_idx, lat, lon, timestamp and transport_mode: files cut at gaps, the parts whose mean place lies in the box, each with the
    mode of the first label that holds it whole, else `unknown`."""
    order = ["timestamp", "line"]
    rows = segment.gap_segments(points, "key", gap_s, "timestamp", order)
    parts = rows.groupBy("user", "stem", "key", "seg").agg(F.avg("lat").alias("a"), F.avg("lon").alias("o"), F.min("timestamp").alias("s"), F.max("timestamp").alias("e"))
    parts = parts.where(F.col("a").between(*box[:2]) & F.col("o").between(*box[2:])).withColumn("seg_id", F.struct("key", "seg"))
    named = context.contained(parts.select("user", "stem", "key", "seg", "seg_id", "s", "e"), labels, "user")
    tid = F.concat_ws("_", F.lit("geolife"), "user", "stem", F.col("seg").cast("string"))
    named = named.select("key", "seg", tid.alias("trajectory_id"), F.col("label").alias("transport_mode"))
    return segment.point_index(rows.join(named, ["key", "seg"]), ["trajectory_id"], order).select("trajectory_id", "point_idx", "lat", "lon", "timestamp", "transport_mode")


# Modes by the labels of the moves.
NYC_MODES = {0: "walk", 1: "bike", 2: "bus", 3: "car", 4: "subway", 5: "train", 6: "taxi"}


def nyc_trips(points: DataFrame, moves: DataFrame | None, seconds: int = 1) -> DataFrame:
    """trajectory_id, lat, lon, timestamp and transport_mode: the first position of each bucket of seconds, and the mode that most
    rows of moves (tid, label) give a trajectory: `unknown` if several do, null without moves or for a label that is none.

    points have traj_id, time, lat and lon; time is a timestamp or nanoseconds since 1970 (as Spark reads such files with
    spark.sql.legacy.parquet.nanosAsLong)."""
    kind = dict(points.dtypes)["time"]
    ts = F.floor(F.col("time") / 1_000_000_000).cast("long") if kind == "bigint" else F.unix_seconds(F.col("time")) if kind == "timestamp" else _wall(F.col("time"))
    rows = points.select("traj_id", ts.alias("timestamp"), "lat", "lon", F.monotonically_increasing_id().alias("event_id"))
    rows = resample.one_per_bucket(rows, ["traj_id"], seconds, "timestamp")
    out = rows.withColumn("trajectory_id", F.concat(F.lit("nyc_"), F.col("traj_id").cast("string")))
    if moves is None:
        return out.select("trajectory_id", "lat", "lon", "timestamp", F.lit(None).cast("string").alias("transport_mode"))
    most = context.majority(moves.select(F.col("tid").cast("string").alias("tid"), F.col("label").cast("int").alias("label")), "tid", "label")
    words = F.create_map(*(F.lit(x) for k, v in NYC_MODES.items() for x in (str(k), v)))
    mode = F.when(F.col("label") == "unknown", "unknown").otherwise(F.try_element_at(words, F.col("label")))
    return out.join(most, out["traj_id"].cast("string") == most["tid"], "left").select("trajectory_id", "lat", "lon", "timestamp", mode.alias("transport_mode"))


def cabspotting(spark: SparkSession, path: str) -> DataFrame:
    """lat lon occupancy time, latest first, within San Francisco's box."""
    f = F.split("value", " ")
    rows = spark.read.text(path).select(_stem().alias("key"), f.alias("f")).where(F.size("f") == 4)
    out = rows.select("key", F.get("f", F.lit(0)).try_cast("double").alias("lat"), F.get("f", F.lit(1)).try_cast("double").alias("lon"), F.get("f", F.lit(3)).try_cast("long").alias("timestamp"))
    return out.where("timestamp is not null and lat between 36.5 and 38.5 and lon between -123.5 and -121.5")


def rome(spark: SparkSession, path: str) -> DataFrame:
    """id;time;POINT(lat lon), in UTC+1."""
    f = F.split("value", ";")
    point = r"POINT\(\s*(\S+)\s+([^)\s]+)\s*\)"
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 3)
    out = rows.select(F.get("f", F.lit(0)).alias("key"), F.regexp_extract(F.get("f", F.lit(2)), point, 1).try_cast("double").alias("lat"), F.regexp_extract(F.get("f", F.lit(2)), point, 2).try_cast("double").alias("lon"), (_seconds(F.substring(F.get("f", F.lit(1)), 1, 19), "yyyy-MM-dd HH:mm:ss") - 3600).alias("timestamp"))
    return out.where("timestamp is not null and lat is not null and lon is not null")


def parquet_points(spark: SparkSession, path: str, key: str = "tripid", ts: str = "ts") -> DataFrame:
    """Positions already in Parquet; only the columns that are used are read."""
    return spark.read.parquet(path).select(F.col(key).cast("string").alias("key"), "lat", "lon", F.col(ts).alias("timestamp"))


def simulated_trips(spark: SparkSession, path: str, prefix: str, every_s: float = 8.0, rows: int = 1_000_000) -> DataFrame:
    """trajectory_id, point_idx, lat, lon and timestamp of Parquet of tripid, lat, lon and ts, where a trip is a run of consecutive rows of one tripid:
    an id that recurs is another trip.  A row is kept if every_s have passed since the last one kept; times are cut to seconds.

    Files are scanned in pieces of ``rows`` rows, and a run goes on across them, so the result does not depend on how files are split."""
    read = spark.read.parquet(path)
    at = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "tripid", "lat", "lon", "ts")
    runs = scan.runs(at, "tripid", "file", "row", rows=rows)
    kept = thin.greedy_thin(runs, ["file", "run"], every_s, "ts", ["ts", "row"])
    names = kept.select("file", "run", "tripid").distinct()
    again = F.row_number().over(Window.partitionBy("tripid").orderBy("file", "run")) - 1
    tid = F.concat(F.lit(f"{prefix}_"), F.coalesce(F.col("tripid").cast("string"), F.lit("null")), F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""))
    named = names.withColumn("n", again).select("file", "run", tid.alias("trajectory_id"))
    out = segment.point_index(kept.join(named, ["file", "run"]), ["trajectory_id"], ["ts", "row"])
    return out.select("trajectory_id", "point_idx", "lat", "lon", F.col("ts").cast("long").alias("timestamp"))
