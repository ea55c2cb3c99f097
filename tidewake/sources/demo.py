"""The driver's tables as a stream of positions and its context layers, by fixed arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import half_even


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def place(a: Column, b: Column) -> tuple[Column, Column]:
    """lat and lon of two numbers."""
    lat = 55 + ((a * 7919 + b * 104729) % 100000) / 100000.0
    lon = 10 + ((a * 6271 + b * 15485863) % 100000) / 50000.0
    return lat, lon


ANNOTATIONS = {"error": "GAP_START", "signup": "STOP_START", "purchase": "STOP_END", "click": "GAP_END", "view": ""}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, mmsi, ts_unix, lat, lon, sog, cog, heading, ship_code, annotation."""
    e = table(spark, sf_dir, "events")
    lat, lon = place(F.col("event_id"), F.col("user_id"))
    note = F.lit("")
    for kind, label in ANNOTATIONS.items():
        note = F.when(F.col("event_type") == kind, label).otherwise(note)
    return e.select(
        "event_id", F.col("user_id").alias("mmsi"), epoch(F.col("ts")).alias("ts_unix"), lat.alias("lat"), lon.alias("lon"),
        (F.col("value") / 4).alias("sog"), (F.col("event_id") * 37 % 400).cast("double").alias("cog"), (F.col("event_id") * 53 % 520).cast("double").alias("heading"),
        (F.col("user_id") % 100).cast("int").alias("ship_code"), note.alias("annotation"),
    )


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """port_id, name, lat, lon."""
    lat, lon = place(F.col("s_suppkey"), F.lit(0))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("port_id"), F.col("s_name").alias("name"), lat.alias("lat"), lon.alias("lon"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, name and ring (array of x, y): overlapping boxes."""
    k = F.col("n_nationkey")
    x, y = 10.000003 + (k % 5) * 0.35, 55.000003 + (k % 7) * 0.12  # no position lies on a border
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(corner(x, y), corner(x + 0.5, y), corner(x + 0.5, y + 0.2), corner(x, y + 0.2))
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("zone_id"), F.col("n_name").alias("name"), ring.alias("ring"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poi_id, category, x, y in metres on a square of 20 km."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("poi_id"), F.col("p_type").alias("category"), (k * 7919 % 20000).cast("double").alias("x"), (k * 6271 % 20000).cast("double").alias("y"))


def parted_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, zone and rings: a box with a hole, and a smaller box beside it."""
    k = F.col("n_nationkey")
    x, y = 10.000003 + (k % 5) * 0.35, 55.000003 + (k % 7) * 0.12
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    box = lambda a, b, c, e: F.array(corner(x + a, y + b), corner(x + c, y + b), corner(x + c, y + e), corner(x + a, y + e))
    rings = F.array(box(0.0, 0.0, 0.5, 0.2), box(0.1, 0.05, 0.3, 0.15), box(0.6, 0.0, 0.7, 0.1))
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("zone_id"), F.col("n_name").alias("zone"), rings.alias("rings"))


def elevations(spark: SparkSession) -> DataFrame:
    """A raster of 17 by 33 nodes, some without a value: lat, lon and elevation."""
    nodes = spark.range(17 * 33).select(F.floor(F.col("id") / 33).alias("i"), (F.col("id") % 33).alias("j"))
    z = F.when((F.col("i") + F.col("j")) % 11 != 0, (F.col("i") * 31 + F.col("j") * 17) % 50 - 30 + 0.25)
    return nodes.select((55 + F.col("i") * 0.0625).alias("lat"), (10 + F.col("j") * 0.0625).alias("lon"), z.alias("elevation"))


def uneven_elevations(spark: SparkSession) -> DataFrame:
    """A raster of 8 by 8 nodes ever farther from each other, some without a value."""
    nodes = spark.range(64).select(F.floor(F.col("id") / 8).alias("i"), (F.col("id") % 8).alias("j"))
    z = F.when((F.col("i") + F.col("j")) % 5 != 0, (F.col("i") * 31 + F.col("j") * 17) % 50 - 30.25)
    return nodes.select((55 + F.col("i") * F.col("i") * 0.015625).alias("lat"), (10 + F.col("j") * F.col("j") * 0.03125).alias("lon"), z.alias("elevation"))


def _circle(k: Column) -> tuple[Column, Column, Column]:
    return 11.0 + (k % 5 - 2) * 0.3, 55.5 + (k % 7 - 3) * 0.1, 0.15 + k * 0.01


def round_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_order, name, kind and rings of 720 corners, overlapping circles about the region's middle."""
    k = F.col("n_nationkey")
    x, y, r = _circle(k)
    turn = F.transform(F.sequence(F.lit(0), F.lit(719)), lambda i: F.radians(i / 2.0))
    ring = F.transform(turn, lambda t: F.struct((x + r * F.cos(t)).alias("x"), (y + r * F.sin(t)).alias("y")))
    kind = F.when(k % 2 == 0, "Territorial sea, 12NM").otherwise("200NM")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("zone_order"), F.col("n_name").alias("name"), kind.alias("kind"), F.array(ring).alias("rings"))


def near_shores(points: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id of the points within a thousandth of a round zone's radius of its shore."""
    x, y, r = _circle(F.col("n_nationkey"))
    circles = table(spark, sf_dir, "nation").select(F.collect_list(F.struct(x.alias("x"), y.alias("y"), r.alias("r"))).alias("circles"))
    far = lambda c: F.sqrt(F.pow(F.col("lon") - c["x"], 2) + F.pow(F.col("lat") - c["y"], 2)) / c["r"]
    near = points.join(F.broadcast(circles))  # one row, of 25 nations
    return near.where(F.exists("circles", lambda c: far(c).between(0.999, 1.001))).select("event_id")


def windows(points: DataFrame) -> DataFrame:
    """w_start: every other window of three days that has positions."""
    k = F.floor(F.col("ts_unix") / 259200)
    return points.select(k.alias("k")).distinct().where("k % 2 = 1").select((F.col("k") * 259200).alias("w_start"))


def ocean(starts: DataFrame) -> DataFrame:
    """A raster in each window: w_start, time (every six hours), lat, lon, and wave, u and v, some null or NaN."""
    nodes = starts.select("w_start", F.explode(F.sequence(F.lit(0), F.lit(12 * 15 - 1))).alias("id"))
    nodes = nodes.select("w_start", F.floor(F.col("id") / 15).alias("k"), F.floor(F.col("id") % 15 / 5).alias("i"), (F.col("id") % 5).alias("j"))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    wave = F.when((i + j + k) % 7 != 0, (i * 7 + j * 5 + k * 3 + F.floor(F.col("w_start") / 259200)) % 40 / 8.0)
    u = F.when((i + 2 * j + k) % 5 == 0, float("nan")).otherwise(((i * 3 + j * 11 + k * 5) % 21 - 10) / 8.0)
    v = ((i * 13 + j * 3 + k * 7) % 21 - 10) / 8.0 + 0.0625
    return nodes.select("w_start", (F.col("w_start") + k * 21600).alias("time"), (55 + i * 0.5).alias("lat"), (10 + j * 0.5).alias("lon"), wave.alias("wave"), u.alias("u"), v.alias("v"))


def weather(points: DataFrame) -> DataFrame:
    """Hourly weather of the cities of positions but one, two hours of three: city, date, hour and values."""
    hours = points.select("city", F.floor(F.col("ts_unix") / 3600).alias("h")).distinct()
    h, n = F.col("h"), F.substring("city", 6, 1).cast("long")
    hours = hours.where((F.col("city") != "city 4") & ((h + n) % 3 != 0))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(h / 24).cast("int"))
    return hours.select(
        "city", F.date_format(day, "yyyy-MM-dd").alias("date"), (h % 24).cast("int").alias("hour"), (h % 30).cast("double").alias("temperature_c"), (h % 9 / 4.0).alias("precipitation_mm"),
        (h % 70 + 0.5).alias("wind_speed_kmh"), (h * 11 % 360).cast("double").alias("wind_direction_deg"), (h * 7 % 100).cast("int").alias("weather_code"),
    )


def gridded_weather(points: DataFrame) -> DataFrame:
    """Hourly weather of the places of positions, of one digit, two hours of three: lat, lon, date, hour and values."""
    hours = points.select(half_even(F.col("lat"), 1).alias("lat"), half_even(F.col("lon"), 1).alias("lon"), F.floor(F.col("ts_unix") / 3600).alias("h")).distinct()
    a, o, h = F.round(F.col("lat") * 10).cast("long"), F.round(F.col("lon") * 10).cast("long"), F.col("h")
    hours = hours.where((h + a + o) % 3 != 0)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(h / 24).cast("int"))
    none = F.lit(None).cast("double")
    return hours.select(
        "lat", "lon", F.date_format(day, "yyyy-MM-dd").alias("date"), (h % 24).cast("int").alias("hour"), ((h + a) % 30).cast("double").alias("temperature_c"), none.alias("precipitation_mm"),
        none.alias("wind_speed_kmh"), none.alias("wind_direction_deg"), (h % 4).cast("int").alias("weather_code"),
    )
