"""Rasters, hourly weather and the rules by which layers' attributes are read.

A raster is a table in long form: a row a node, with its coordinates on regular axes.  A point meets its nearest node by an
equi-join on the nodes' places on the axes, so rasters of any size are shuffled or broadcast as Spark sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_even
from ..functions.names import free
from ..functions.scalars import rank_in
from .tasks import numbered

# Weather codes, place classes and land-use tags as the source data define them.
WMO = {0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "rime fog", 51: "light drizzle", 53: "moderate drizzle", 55: "heavy drizzle", 56: "light freezing drizzle", 57: "heavy freezing drizzle", 61: "light rain", 63: "moderate rain", 65: "heavy rain", 66: "light freezing rain", 67: "heavy freezing rain", 71: "light snow", 73: "moderate snow", 75: "heavy snow", 77: "snow grains", 80: "light rain showers", 81: "moderate rain showers", 82: "violent rain showers", 85: "light snow showers", 86: "heavy snow showers", 95: "thunderstorm", 96: "thunderstorm with light hail", 99: "thunderstorm with heavy hail"}
PLACE_RULES = [
    ("amenity", ["restaurant", "cafe", "bar", "fast_food", "food_court", "pub", "ice_cream", "bakery", "biergarten"], "food_drink"),
    ("amenity", ["school", "university", "college", "library", "kindergarten"], "education"),
    ("amenity", ["hospital", "clinic", "pharmacy", "doctors", "dentist", "veterinary"], "healthcare"),
    ("amenity", ["bus_station", "taxi", "car_rental", "bicycle_rental", "fuel", "parking"], "transport"),
    ("amenity", ["hotel"], "accommodation"),
    ("amenity", ["bank", "atm"], "office_finance"),
    ("amenity", ["place_of_worship"], "religion"),
    ("amenity", ["town_hall", "police", "fire_station", "post_office", "courthouse", "embassy"], "government"),
    ("amenity", ["theatre", "cinema", "arts_centre", "nightclub"], "culture"),
    ("shop", None, "retail"),
    ("leisure", ["park", "sports_centre", "playground", "gym", "swimming_pool", "stadium", "fitness_centre"], "recreation"),
    ("tourism", ["hotel", "hostel", "motel", "guest_house", "chalet"], "accommodation"),
    ("tourism", ["museum", "gallery", "attraction", "artwork", "viewpoint"], "culture"),
    ("office", None, "office_finance"),
    ("railway", ["station", "halt", "tram_stop", "subway_entrance"], "transport"),
    ("public_transport", ["station", "stop_position"], "transport"),
]


def axis_index(x: Column, start: Column | float, step: float, n: int) -> Column:
    """The place (from 0) of the nearest of n nodes on a regular axis, the later of two as near; beyond the ends the last."""
    at = F.floor((x - start) / step + 0.5)
    return F.when(at.isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("long"))


def nearest_index(x: Column, nodes: Column) -> Column:
    """The place (from 0) of the nearest of the nodes, a sorted array, the later of two as near; null for null or NaN."""
    x = x.cast("double")
    at = rank_in(nodes, x)  # nodes not above x
    low, high = F.get(nodes, at - 1), F.get(nodes, at)
    later = F.coalesce((high - x <= x - low) | low.isNull(), F.lit(False))
    return F.when(x.isNotNull() & ~F.isnan(x), (at - 1 + later.cast("int")).cast("long"))


MOST_NODES = 100_000


def axis(raster: DataFrame, column: str) -> DataFrame:
    """One row, _axis: the sorted coordinates of a raster's axis, regular or not; counted first, as it passes to every task."""
    c = F.col(column).cast("double")
    every = raster.where(c.isNotNull() & ~F.isnan(c)).select(c.alias("c")).distinct()
    if every.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes on the axis {column}")
    return every.agg(F.sort_array(F.collect_list("c")).alias("_axis"))


MOST_WINDOWS = 20_000


def window_start(points: DataFrame, starts: DataFrame, ts: str = "ts_unix", name: str = "w_start", most: int = MOST_WINDOWS) -> DataFrame:
    """points with the latest of starts (a table of one column of times, a row a window) at or before ts, else the first.

    The starts pass to every task as one sorted array of at most ``most``.  Of more, every so many-th does; a point finds its block
    of starts in it and meets that block by an equi-join."""
    column = starts.columns[0]
    every = starts.where(F.col(column).isNotNull()).select(F.col(column).alias("s")).distinct()
    n = every.count()
    starts_, block, held = free(points, "_starts", "_block", "_held")
    size = -(-n // most) if n else 1
    blocks = every.select(F.lit(0).cast("long").alias(block), "s") if size == 1 else numbered(every, "s").select(F.floor((F.col("_i") - 1) / size).cast("long").alias(block), "s")
    blocks = blocks.groupBy(block).agg(F.sort_array(F.collect_list("s")).alias(held))  # ``most`` or size of them
    if size == 1:
        rows = points.join(F.broadcast(blocks), F.lit(True), "left")  # one row at most
    else:
        firsts = blocks.agg(F.sort_array(F.collect_list(F.get(held, F.lit(0)))).alias(starts_))
        rows = points.join(F.broadcast(firsts))  # one row
        rows = rows.withColumn(block, F.greatest(rank_in(F.col(starts_), F.col(ts)) - 1, F.lit(0)).cast("long")).drop(starts_).join(blocks, block, "left")
    at = F.get(F.col(held), F.greatest(rank_in(F.col(held), F.col(ts)) - 1, F.lit(0)))
    return rows.select(*(c for c in points.columns if c != name), at.alias(name))


def raster_at(points: DataFrame, raster: DataFrame, axes: dict[str, tuple | None], values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """points with the values of their nearest node, which replace columns of their names; null where the node is absent, null
    or NaN, or a coordinate is.

    axes: by column, which both sides have, (start, step, n) of its nodes, where start may be a column of both sides, as a
    window's first time; or None for any spacing, as the raster's nodes have it.  keys are columns that must be equal, as a window's."""
    on = dict(zip(axes, free(points, *(f"_{c}_at" for c in axes))))
    marks = dict(zip(axes, free(points, *(f"_{c}_axis" for c in axes))))

    def place(df: DataFrame) -> DataFrame:
        for c, spec in axes.items():
            if spec is None:
                df = df.join(F.broadcast(axis(raster, c).withColumnRenamed("_axis", marks[c])))  # one row
                df = df.withColumn(on[c], nearest_index(F.col(c), F.col(marks[c]))).drop(marks[c])
            else:
                start, step, n = spec
                df = df.withColumn(on[c], axis_index(F.col(c), F.col(start) if isinstance(start, str) else start, step, n))
        return df

    joined = [*on.values(), *keys]
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    nodes = place(raster.select(*dict.fromkeys([*axes, *keys, *(s[0] for s in axes.values() if s and isinstance(s[0], str)), *values]))).select(*joined, *(known(v).alias(v) for v in values))
    own = [c for c in points.columns if c not in values]
    return place(points.select(*dict.fromkeys([*own]))).join(nodes, joined, "left").select(*own, *values)


def depth(elevation: Column) -> Column:
    """Metres below sea level, null on land."""
    return F.when(elevation < 0, half_even(F.abs(elevation), 1))


def hourly(points: DataFrame, weather: DataFrame, keys: list[str], ts: str = "ts_unix") -> DataFrame:
    """points with temperature_c, precipitation_mm, wind_speed_kmh, wind_direction_deg, weather_code and weather_description, which
    replace columns of their names, of the hour they are in, by keys (a city, or coordinates), date (yyyy-mm-dd) and hour, in UTC.

    Texts are compared in lower case, coordinates rounded to one digit.  What is not found is null, its code -1 and its description
    `unknown`.  A null key finds nothing; the row stays.  weather has at most one row a key, date and hour."""
    columns = ["temperature_c", "precipitation_mm", "wind_speed_kmh", "wind_direction_deg", "weather_code"]
    own = [c for c in points.columns if c not in (*columns, "weather_description")]
    marks = free(points, *(f"_{k}_at" for k in keys), "_date", "_hour")

    def plain(df: DataFrame, k: str) -> Column:
        kind = dict(df.dtypes)[k]
        return F.lower(k) if kind == "string" else half_even(F.col(k), 1) if kind in ("float", "double") else F.col(k)

    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / 86400).cast("int"))
    hour = F.floor(F.pmod(F.col(ts), F.lit(86400)) / 3600).cast("int")
    rows = points.withColumns(dict(zip(marks, [*(plain(points, k) for k in keys), F.date_format(day, "yyyy-MM-dd"), hour])))
    layer = weather.select(*(c.alias(m) for c, m in zip([*(plain(weather, k) for k in keys), F.col("date").cast("string"), F.col("hour").cast("int")], marks)), *columns)
    out = rows.drop(*columns).join(layer, marks, "left")
    out = out.withColumn("weather_code", F.coalesce("weather_code", F.lit(-1)).cast("int"))
    return out.withColumn("weather_description", code_text(F.col("weather_code"))).select(*own, *columns, "weather_description")


def code_text(code: Column) -> Column:
    """The words of a weather code, `unknown` without them."""
    words = F.create_map(*(F.lit(x) for pair in WMO.items() for x in pair))
    return F.coalesce(F.try_element_at(words, code.cast("int")), F.lit("unknown"))


def reanalysis_text(celsius: Column, mm: Column) -> Column:
    """Weather in words from temperature and hourly precipitation; the thresholds are fixed values."""
    missing = celsius.isNull() | F.isnan(celsius) | mm.isNull() | F.isnan(mm)
    wet = F.when((mm >= 0.5) & (celsius < 2.0), "snow").when(mm >= 4.0, "heavy rain").when(mm >= 0.3, "moderate rain").when(mm >= 0.05, "light rain")
    return F.when(missing, "unknown").otherwise(wet.otherwise("dry"))


def place_class(df: DataFrame) -> Column:
    """The class of a place by its tags, a column each; the first rule that holds, else `other`."""
    out = F
    for tag, values, name in PLACE_RULES:
        if tag in df.columns:
            out = out.when(F.col(tag).isNotNull() if values is None else F.col(tag).cast("string").isin(values), name)
    return F.lit("other") if out is F else out.otherwise("other")


def land_use(df: DataFrame) -> Column:
    """An area's use: its landuse tag, else leisure, else amenity, else `other`."""
    tags = [F.when(~F.col(c).cast("string").eqNullSafe("NaN"), F.col(c).cast("string")) for c in ("landuse", "leisure", "amenity") if c in df.columns]
    return F.coalesce(*tags, F.lit("other"))


def zone_state(df: DataFrame) -> Column:
    """Three letters of the state whose zone it is, `high_seas` without one."""
    owner = next((F.col(c) for c in ("ISO_SOV1", "SOVEREIGN1") if c in df.columns), F.lit(""))
    return F.coalesce(F.nullif(F.substring(owner, 1, 3), F.lit("")), F.lit("high_seas"))


def territorial(pol_type: Column) -> Column:
    return F.coalesce(pol_type.contains("12NM") | pol_type.contains("Territorial"), F.lit(False))
