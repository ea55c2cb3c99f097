"""Points in zones of any size: coverings of polygons by square cells of several levels, and what zones say of a point.

A cell keeps the edges that touch it and whether its reference point is inside.  A point of the cell is inside if that is so and
the way from the reference point, first along x, then along y, crosses an even number of the cell's edges (or the other
way round), so a cell answers for itself, whatever lies beyond.  A polygon starts in the one to four cells about as wide as
itself; cells with more than CELL_EDGES edges are quartered twice, which gives each part its edges and its reference point's side
from the cell's own edges.  Cells without edges are all inside or all outside; these are dropped, and those are single rows, so an
ocean is as many rows as its shore needs.  Points meet cells by level and place, an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free
from ..functions.scalars import city_of
from ..functions.scratch import settled
from .context import nearest, port_label
from .layers import land_use, territorial, zone_state
from .neighbours import finite

CELL_EDGES = 32
MAP_CELLS = 20_000
"""Coverings of at most so many cells, which are counted, pass to every task, so that points are not shuffled.  A cell has at most
CELL_EDGES edges, but for those of the least level."""
LEAST_LEVEL = -20  # cells are 2^level wide; smaller ones are not cut
REF_X, REF_Y = 0.381966011250105, 0.276393202250021  # the reference point's place in a cell, on no round coordinate


def _edges(ring: Column) -> Column:
    after = lambda i: F.get(ring, (i + 1) % F.size(ring))
    return F.transform(ring, lambda p, i: F.struct(*(v.cast("double").alias(n) for v, n in ((p["x"], "ax"), (p["y"], "ay"), (after(i)["x"], "bx"), (after(i)["y"], "by")))))


def _odd(edges: Column, crosses) -> Column:
    return F.size(F.filter(edges, crosses)) % 2 == 1


def _inside(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting: an odd number of edges lies to the right; so holes and separate parts are rings like any other."""
    return _odd(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))


def _x_at(e: Column, y: Column) -> Column:
    return (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]


def _y_at(e: Column, x: Column) -> Column:
    return (e["by"] - e["ay"]) * (x - e["ax"]) / (e["bx"] - e["ax"]) + e["ay"]


def _sides_differ(x0: Column, y0: Column, x1: Column, y1: Column, edges: Column) -> Column:
    """Whether the way from one point along x, then along y, to another crosses an odd number of edges."""

    def along_x(e: Column) -> Column:
        at = _x_at(e, y0)
        return ((e["ay"] > y0) != (e["by"] > y0)) & ((x0 < at) != (x1 < at))

    def along_y(e: Column) -> Column:
        at = _y_at(e, x1)
        return ((e["ax"] > x1) != (e["bx"] > x1)) & ((y0 < at) != (y1 < at))

    return _odd(edges, along_x) != _odd(edges, along_y)


def _width(level: Column) -> Column:
    return F.pow(F.lit(2.0), level.cast("double"))


def _ref(level: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    return (cx + F.lit(REF_X)) * _width(level), (cy + F.lit(REF_Y)) * _width(level)


def _touching(level: Column, cx: Column, cy: Column, edges: Column) -> Column:
    """The edges that may touch a cell: their box does, and the cell's corners are not all on one side of them."""
    w = _width(level)
    slack = w * 1e-9
    x0, y0, x1, y1 = cx * w - slack, cy * w - slack, (cx + 1) * w + slack, (cy + 1) * w + slack

    def touches(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        side = lambda x, y: dx * (y - e["ay"]) - dy * (x - e["ax"])
        corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        box = (F.least(e["ax"], e["bx"]) <= x1) & (F.greatest(e["ax"], e["bx"]) >= x0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ay"], e["by"]) >= y0)
        return box & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.filter(edges, touches)


def covering(polygons: DataFrame, values: list[str], most: int = CELL_EDGES) -> DataFrame:
    """_level, _cx, _cy, _in (whether the reference point is inside), _e (edges, none where the whole cell is inside) and _v, a struct of
    values: the cells of each polygon.

    polygons have a ring (array of x, y) or rings (several: parts, and holes in them).  Those without three finite corners hold
    nothing."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    shapes = polygons.select(F.struct(*values).alias("_v"), F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), _edges)).alias("_e"))
    shapes = shapes.where((F.size("_e") >= 3) & F.forall("_e", lambda e: finite(e["ax"], e["ay"])))
    ends = lambda f, c: f(F.transform("_e", lambda e: e[c]))
    x0, x1, y0, y1 = ends(F.array_min, "ax"), ends(F.array_max, "ax"), ends(F.array_min, "ay"), ends(F.array_max, "ay")
    level = F.greatest(F.ceil(F.log2(F.greatest(x1 - x0, y1 - y0, F.lit(2.0**LEAST_LEVEL)))), F.lit(LEAST_LEVEL)).cast("int")
    rows = shapes.withColumns({"_level": level, "_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1})
    span = lambda a, b: F.explode(F.sequence(*(F.floor(F.col(c) / _width(F.col("_level"))).cast("long") for c in (a, b))))
    rows = rows.select("_v", "_e", "_level", "_y0", "_y1", span("_x0", "_x1").alias("_cx")).select("_v", "_e", "_level", "_cx", span("_y0", "_y1").alias("_cy"))
    cell = [F.col(c) for c in ("_level", "_cx", "_cy")]
    rows = rows.select("_v", *cell, _inside(*_ref(*cell), F.col("_e")).alias("_in"), _touching(*cell, F.col("_e")).alias("_e"))
    kept = (F.size("_e") > 0) | F.col("_in")
    columns = ["_level", "_cx", "_cy", "_in", "_e", "_v"]
    done, step = [], F.sequence(F.lit(0), F.lit(3))
    while True:
        rows = settled(rows.where(kept).select(*columns))
        full = (F.size("_e") > most) & (F.col("_level") - 2 >= LEAST_LEVEL)
        done.append(rows.where(~full))
        if rows.where(full).isEmpty():
            return reduce(DataFrame.unionByName, done)
        part = rows.where(full).withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
        part = part.withColumns({"_l2": F.col("_level") - 2, "_x2": F.col("_cx") * 4 + F.col("_i"), "_y2": F.col("_cy") * 4 + F.col("_j")})
        child = [F.col(c) for c in ("_l2", "_x2", "_y2")]
        inside = F.col("_in") != _sides_differ(*_ref(*cell), *_ref(*child), F.col("_e"))
        # Named afterwards: in a lambda Spark takes a select's own alias before the column of that name.
        rows = part.select(*child, inside, _touching(*child, F.col("_e")), "_v").toDF(*columns)


def holding(points: DataFrame, polygons: DataFrame, key: str, values: list[str], x: str = "x", y: str = "y", most: int = CELL_EDGES) -> DataFrame:
    """_key and _v, a struct of values, for each point and polygon that holds it."""
    return _met(points, covering(polygons, values, most), key, x, y)


def _levels(cells: DataFrame) -> list[int]:
    return sorted(r[0] for r in cells.select("_level").distinct().collect())  # a few dozen at most, by the width of numbers


def _met(points: DataFrame, cells: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """holding() by a covering: points meet its cells by level and place."""
    levels = _levels(cells)
    own = points.where(finite(F.col(x), F.col(y))).select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    own = own.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    place = lambda c: F.floor(F.col(c) / _width(F.col("_level"))).cast("long")
    met = own.withColumns({"_cx": place("_x"), "_cy": place("_y")}).join(cells, ["_level", "_cx", "_cy"])
    ref = _ref(*(F.col(c) for c in ("_level", "_cx", "_cy")))
    return met.where(F.col("_in") != _sides_differ(*ref, F.col("_x"), F.col("_y"), F.col("_e"))).select("_key", "_v")


def in_polygon(points: DataFrame, polygons: DataFrame, key: str, pick: str, values: list[str], columns: tuple[str, str] = ("x", "y"), most: int = CELL_EDGES) -> DataFrame:
    """points with values of the polygon with the least ``pick`` (of one pick, the least values) among those that hold the point;
    null without one.  They replace columns of their names.  key is unique; a null key finds its polygon as well."""
    names = list(dict.fromkeys([pick, *values]))
    cells = covering(polygons, names, most)
    if cells.limit(MAP_CELLS + 1).count() <= MAP_CELLS:
        best, own = _best_in_place(points, cells, pick, *columns)
    else:
        found = _met(points, cells, key, *columns).groupBy("_key").agg(F.min(F.struct(F.col("_v")[pick].alias("p"), "_v"))["_v"].alias("_v"))
        mark, own = free(points, "_key", "_v")
        best = points.join(found.withColumnsRenamed({"_key": mark, "_v": own}), F.col(key).eqNullSafe(F.col(mark)), "left")
    return best.select(*(c for c in points.columns if c not in values), *(F.col(own)[v].alias(v) for v in values))


def _best_in_place(points: DataFrame, cells: DataFrame, pick: str, x: str, y: str) -> tuple[DataFrame, str]:
    """points with a column more, which is named too: the values of the polygon with the least pick that holds the point.  Each
    level's cells, one row a place, are broadcast; points stay where they are."""
    best, px, py = free(points, "_best", "_px", "_py")
    there = finite(F.col(x), F.col(y))
    out, found = points.withColumns({p: F.when(there, F.col(c).cast("double")) for p, c in ((px, x), (py, y))}), []

    def least_of(held: Column, rx: Column) -> Column:
        """As _sides_differ has it; where the ways along x cross is known beforehand."""
        at_x, at_y = F.col(px), F.col(py)

        def crosses(c: Column) -> Column:
            along_y = _odd(c["_e"], lambda e: ((e["ax"] > at_x) != (e["bx"] > at_x)) & ((c["_ry"] < _y_at(e, at_x)) != (at_y < _y_at(e, at_x))))
            return _odd(c["_xs"], lambda at: (rx < at) != (at_x < at)) != along_y

        return F.array_min(F.transform(F.filter(held, lambda c: c["_in"] != crosses(c)), lambda c: F.struct(c["_v"][pick].alias("p"), c["_v"].alias("v"))))

    for level in _levels(cells):
        rx, ry = _ref(F.lit(level), F.col("_cx"), F.col("_cy"))
        one = cells.where(F.col("_level") == level).withColumns({"_rx": rx, "_ry": ry})
        ahead = F.transform(F.filter("_e", lambda e: (e["ay"] > F.col("_ry")) != (e["by"] > F.col("_ry"))), lambda e: _x_at(e, F.col("_ry")))
        one = one.withColumn("_xs", ahead).groupBy("_cx", "_cy", "_rx").agg(F.collect_list(F.struct("_in", "_e", "_xs", "_ry", "_v")).alias("_c"))  # MAP_CELLS bounds it
        mx, my, mr, mc = free(out, "_cx", "_cy", "_rx", "_held")
        place = [F.floor(F.col(p) / F.lit(2.0**level)).cast("long") for p in (px, py)]
        out = out.join(F.broadcast(one.toDF(mx, my, mr, mc)), (place[0] == F.col(mx)) & (place[1] == F.col(my)), "left")
        found.append(least_of(F.col(mc), F.col(mr)))
    if not found:
        return out.withColumn(best, F.lit(None).cast(cells.schema["_v"].dataType)), best
    least = F.least(*found) if len(found) > 1 else found[0]
    return out.withColumn(best, least["v"]).select(*points.columns, best), best


def with_land_use(points: DataFrame, areas: DataFrame | None, key: str, columns: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """points with land_use: of several areas the first use by name, `other` in one without tags, `unknown` in none."""
    if areas is None:
        return points.withColumn("land_use", F.lit("unknown"))
    shape = "rings" if "rings" in areas.columns else "ring"
    out = in_polygon(points, areas.select(shape, land_use(areas).alias("land_use")), key, "land_use", ["land_use"], columns)
    return out.withColumn("land_use", F.coalesce("land_use", F.lit("unknown")))


def _first_name(df: DataFrame, *names: str) -> Column:
    return F.coalesce(next((F.col(c).cast("string") for c in names if c in df.columns), F.lit("")), F.lit(""))


def with_maritime_context(points: DataFrame, key: str, ports: DataFrame | None = None, harbours: DataFrame | None = None, protected: DataFrame | None = None,
                          separation: DataFrame | None = None, seas: DataFrame | None = None, eez: DataFrame | None = None) -> DataFrame:
    """points (lat, lon, annotation) with nearest_port_nm (two digits), nearest_port_name, port_proximity_label, in_port_zone, in_mpa,
    mpa_name, in_tss, tss_name, sea_area_name, eez_country_iso and in_territorial_sea, which replace columns of their names.

    Layers of zones have zone_order, by which the first of several counts, and a ring or rings; a layer that is absent leaves its
    columns at their defaults: null, empty, false, `high_seas`.  A column city becomes the sea's name where there is one."""
    layers = {
        "port": (harbours, {"in_port_zone": F.lit(True)}),
        "mpa": (protected, {"in_mpa": F.lit(True), "mpa_name": _first_name(protected, "name_int") if protected else None}),
        "tss": (separation, {"in_tss": F.lit(True), "tss_name": _first_name(separation, "name_int") if separation else None}),
        "sea": (seas, {"sea_area_name": _first_name(seas, "NAME", "name", "name_int") if seas else None}),
        "eez": (eez, {"eez_country_iso": zone_state(eez) if eez else None, "in_territorial_sea": territorial(_first_name(eez, "POL_TYPE")) if eez else None}),
    }
    defaults = {"in_port_zone": False, "in_mpa": False, "mpa_name": "", "in_tss": False, "tss_name": "", "sea_area_name": "", "eez_country_iso": "high_seas", "in_territorial_sea": False}
    out = points.drop(*defaults)
    for layer, said in layers.values():
        if layer is not None:
            shape = "rings" if "rings" in layer.columns else "ring"
            zones = layer.select(shape, "zone_order", *(c.alias(n) for n, c in said.items()))
            out = in_polygon(out, zones, key, "zone_order", list(said), ("lon", "lat"))
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) if c in out.columns else F.lit(v) for c, v in defaults.items()})
    out = out.drop("nearest_port_nm", "nearest_port_name")
    if ports is not None:
        near = nearest(points, ports, key).withColumnsRenamed({"port": "nearest_port_name", "nm": "nearest_port_nm"})
        own = free(out, "_near_key")[0]
        out = out.join(near.withColumnRenamed(key, own), F.col(key).eqNullSafe(F.col(own)), "left").drop(own)
    else:
        out = out.withColumns({"nearest_port_nm": F.lit(None).cast("double"), "nearest_port_name": F.lit("")})
    stopped = F.coalesce(F.col("annotation").contains("STOP_START") | F.col("annotation").contains("STOP_END"), F.lit(False)) if "annotation" in points.columns else F.lit(False)
    nm = F.rint(F.col("nearest_port_nm") * 100) / 100
    out = out.withColumns({"nearest_port_nm": nm, "nearest_port_name": F.coalesce("nearest_port_name", F.lit(""))})
    if "city" in out.columns:
        out = out.withColumn("city", city_of(F.col("city"), F.col("sea_area_name")))
    return out.withColumn("port_proximity_label", port_label(stopped, F.col("in_port_zone"), F.col("nearest_port_nm")))
