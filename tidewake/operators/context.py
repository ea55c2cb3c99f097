"""Joins of positions with their context: layers, rasters, labels and weather.

Nearest, range and containment joins are turned into equi-joins on grid cells, which Spark can shuffle and broadcast as
it sees fit, and refined exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_even
from ..functions.names import free
from . import neighbours


def recovered(points: DataFrame, raw: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join on keys, with matched telling whether the join found a row."""
    return points.join(raw.select(*keys, *columns, F.lit(True).alias("matched")), keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def majority(labels: DataFrame, key: str, label: str) -> DataFrame:
    """key and label, as text: the most frequent one, `unknown` if several are."""
    n = labels.groupBy(key, label).agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.max(F.struct("n", label)).alias("best"), F.collect_list("n").alias("ns"))
    ties = F.size(F.filter("ns", lambda x: x == F.col("best.n")))
    return top.select(key, F.when(ties > 1, "unknown").otherwise(F.col(f"best.{label}").cast("string")).alias(label))


def contained(segments: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """label of the first interval (t0, t1, label, label_order) that holds a segment (s, e, of seg_id), else `unknown`.

    Intervals are dealt to the one or two bins of time about as wide as themselves; a segment meets, of each width there is, the
    bin it starts in.  So a key of many intervals is no product of them and its segments."""
    width = F.ceil(F.log2(F.greatest(F.col("t1") - F.col("t0"), F.lit(1)).cast("double"))).cast("int")
    dealt = intervals.where("t0 <= t1").withColumn("_w", width)
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_w").cast("double"))).cast("long")
    dealt = dealt.select(key, "t0", "t1", "label", "label_order", "_w", F.explode(F.array_distinct(F.array(place("t0"), place("t1")))).alias("_bin"))
    widths = sorted(r[0] for r in dealt.select("_w").distinct().collect())  # 64 at most
    asked = segments.select(key, "seg_id", "s", "e", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")).alias("_w")).withColumn("_bin", place("s"))
    hit = asked.join(dealt, [key, "_w", "_bin"]).where("t0 <= s and e <= t1").groupBy("seg_id").agg(F.min_by("label", "label_order").alias("label"))
    return segments.drop("label").join(hit, "seg_id", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def as_of(points: DataFrame, windows: DataFrame, key: str, ts: str = "ts_unix", start: str = "w_start", value: str = "w_value") -> DataFrame:
    """The value of the latest window that starts at or before a point, else of the first window: both sides in one order
    per group (column g: what the axis belongs to), the last window carried on."""
    both = points.select("g", F.col(ts).alias("_t"), F.lit(1).alias("_k"), key, F.lit(None).cast(windows.schema[value].dataType).alias("_v"))
    both = both.unionByName(windows.select("g", F.col(start).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(points.schema[key].dataType).alias(key), F.col(value).alias("_v")))
    w = Window.partitionBy("g").orderBy("_t", "_k")
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(before, after)).where("_k = 1").select(key, value)


def cells(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


def nearest(points: DataFrame, places: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """key, port name and nm (degrees times 60, on the plane) of the nearest place, however far; ties to the smaller
    port_id.  Without places, or for points whose lat or lon is null, NaN or infinite, both are null.  least: as
    neighbours.one_nearest() has it."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    named = places.where(neighbours.finite(lat, lon)).select(F.struct("port_id", F.col("name").alias("port"), lat.alias("x"), lon.alias("y")).alias("_item"))
    x, y = F.col("_item.x"), F.col("_item.y")
    named = named.groupBy(x.alias("x"), y.alias("y")).agg(F.min("_item").alias("_item")).select("_item")  # of one place only the least can be nearest
    boxed = named.withColumn("_box", F.struct(x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1")))
    own = points.select(F.col(key).alias("_key"), lat.alias("_x"), lon.alias("_y"))
    far = lambda x, y, item: F.sqrt(F.pow(x - item["x"], 2) + F.pow(y - item["y"], 2))
    found = neighbours.one_nearest(own, boxed, far, least)
    return found.select(F.col("_key").alias(key), F.col("_b.item.port").alias("port"), (F.col("_b.d") * 60).alias("nm"))


def port_label(stopped: Column, in_zone: Column, nm: Column) -> Column:
    """The later rule wins: anchorage, coastal, approach, berth.  No port is a far one."""
    nm = F.coalesce(nm, F.lit(9999.0))
    return F.when(in_zone & (nm < 0.5), "berthed").when(nm < 5, "port_approach").when(nm < 20, "coastal").when(stopped & ~in_zone & (nm >= 5), "open_anchorage").otherwise("offshore")


def poi_profile(points: DataFrame, pois: DataFrame, key: str, radii: tuple[int, ...] = (50, 200, 500), mode: str = "circle") -> DataFrame:
    """poi_count_<r>m and poi_categories_<r>m, the categories' counts (JSON, most frequent first), for each radius; mode
    `envelope` takes the square around a point.  Points meet the pois of 3 by 3 cells as wide as the largest radius.

    Pois of one place and category meet points as one row with their number, and points of one place as one.  What meets is merged:
    a table's size on disk says nothing of its ninefold rows, which a broadcast would bring to the driver."""
    size = float(max(radii))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a, b = cells(F.col("x"), F.col("y"), size)
    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    dealt = pois.groupBy("category", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("_w"))
    dealt = dealt.select("category", "_w", F.col("x").alias("px"), F.col("y").alias("py"), a.alias("_a"), b.alias("_b")).withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    dealt = dealt.select("category", "_w", "px", "py", (F.col("_a") + F.col("_i")).alias("_a"), (F.col("_b") + F.col("_j")).alias("_b"))
    dx, dy = F.abs(F.col("px") - F.col("x")), F.abs(F.col("py") - F.col("y"))
    far = F.greatest(dx, dy) if mode == "envelope" else F.sqrt(dx * dx + dy * dy)
    near = places.select("x", "y", a.alias("_a"), b.alias("_b")).join(dealt.hint("merge"), ["_a", "_b"]).withColumn("d", far).where(F.col("d") <= size)
    n = near.groupBy("x", "y", "category").agg(*(F.sum(F.when(F.col("d") <= r, F.col("_w")).otherwise(0)).alias(f"n_{r}") for r in radii))
    entries = lambda r: F.sort_array(F.collect_list(F.when(F.col(f"n_{r}") > 0, F.struct((-F.col(f"n_{r}")).alias("k"), "category"))))
    counts = n.groupBy("x", "y").agg(*(F.sum(f"n_{r}").alias(f"n_{r}") for r in radii), *(entries(r).alias(f"e_{r}") for r in radii))
    text = lambda r: F.to_json(F.map_from_entries(F.transform(f"e_{r}", lambda x: F.struct(x["category"], -x["k"]))))
    found = counts.select(F.col("x").alias("_x"), F.col("y").alias("_y"), *(c for r in radii for c in (F.col(f"n_{r}").alias(f"_n_{r}"), text(r).alias(f"_t_{r}"))))
    own = points.select(key, "x", "y").join(found.hint("merge"), (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y")), "left")
    columns = [(F.coalesce(f"_n_{r}", F.lit(0)).cast("long").alias(f"poi_count_{r}m"), F.coalesce(f"_t_{r}", F.lit("{}")).alias(f"poi_categories_{r}m")) for r in radii]
    return own.select(key, *(c for pair in columns for c in pair))


def snapped(x: Column, start: float, step: float) -> Column:
    """The index of the nearest node of a regular axis."""
    return F.round((x - start) / step).cast("long")


def via_unique(points: DataFrame, digits: int, feature, columns: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """feature(unique rounded coordinates) joined back: costly features are found once per place.  They replace columns of their
    names; a place without coordinates is one of its own."""
    lat, lon = columns
    a, b = free(points, "_lat", "_lon")
    rounded = points.withColumns({a: half_even(F.col(lat), digits), b: half_even(F.col(lon), digits)})
    unique = rounded.select(F.col(a).alias(lat), F.col(b).alias(lon)).distinct()
    found = feature(unique)
    new = [c for c in found.columns if c not in columns]
    x, y = free(rounded, "_x", "_y")
    found = found.withColumnsRenamed({lat: x, lon: y})
    out = rounded.drop(*new).join(found, F.col(a).eqNullSafe(F.col(x)) & F.col(b).eqNullSafe(F.col(y)), "left")
    return out.drop(a, b, x, y)
