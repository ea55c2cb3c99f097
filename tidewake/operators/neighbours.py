"""Exact k nearest neighbours on the plane, of points or line pieces, at any distance and any density.

The things searched are packed into a tree: cut into slabs by x and these into leaves by y, so that every leaf holds ``leaf`` of
them (the last ones up to twice as many) wherever they lie, however crowded; leaves are packed into nodes of FANOUT alike, up to
one root.  A row a node holds its children's boxes.

A point first goes down to one leaf, always to the nearest box; the k-th distance there bounds the search.  Then it goes down
again, now to every box that may hold something nearer or a tie of a smaller id, and compares with what it meets.  A level is an equi-join by node, a
broadcast where the level is counted small.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import settled
from .tasks import numbered

LEAF = 3
FANOUT = 8
BROADCAST_NODES = 20_000
ONE_TASK = 100_000  # so few rows are numbered in one task
CELL_THINGS = 8
CELLS_FROM = 8  # so many points a thing are worth cells


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        c = c.cast("double")
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def _tiled(rows: DataFrame, n: int, size: int, tie: str) -> DataFrame:
    """rows (with _box) with _node: tiles of ``size`` rows, by slabs of the boxes' middles."""
    mid = lambda a, b: (F.col(f"_box.{a}") + F.col(f"_box.{b}")) / 2
    rows = rows.withColumns({"_mx": mid("x0", "x1"), "_my": mid("y0", "y1")})
    tiles = max(1, n // size)
    per_slab = max(1, math.isqrt(tiles)) * size
    if n <= ONE_TASK:
        rows = rows.withColumn("_i", F.row_number().over(Window.orderBy("_mx", "_my", tie)))
    else:
        rows = numbered(rows, "_mx", "_my", tie).drop("_n")
    slabs = max(1, n // per_slab)
    slab = F.least(F.floor((F.col("_i") - 1) / per_slab), F.lit(slabs - 1))  # what is over joins the last slab, and leaf
    rows = rows.withColumn("_slab", slab).withColumn("_j", F.row_number().over(Window.partitionBy("_slab").orderBy("_my", "_mx", tie)) - 1)
    whole, last = per_slab // size, max(1, (n - (slabs - 1) * per_slab) // size)
    tile = F.least(F.floor(F.col("_j") / size), F.when(F.col("_slab") == slabs - 1, last - 1).otherwise(whole - 1))
    return rows.withColumn("_node", (F.col("_slab") * whole + tile).cast("long")).drop("_mx", "_my", "_i", "_slab", "_j")


def _hint(level: DataFrame, n: int) -> DataFrame:
    return F.broadcast(level) if n <= BROADCAST_NODES else level


def tree(things: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels from the leaves up: _node and _kids, structs of _box, _low (the least id within) and _item (in leaves) or _child.

    things have _item (a struct whose first field is the id by which ties are decided) and _box (x0, y0, x1, y1, finite)."""
    n, rows, what, size = things.count(), things.withColumn("_low", F.col("_item").getField(things.schema["_item"].dataType[0].name)), "_item", leaf
    levels = []
    while n:
        tiled = _tiled(rows, n, size, "_low" if what == "_item" else what)
        side = lambda f, c: f(F.col(f"_box.{c}")).alias(c)
        box = F.struct(side(F.min, "x0"), side(F.min, "y0"), side(F.max, "x1"), side(F.max, "y1")).alias("_box")
        level = settled(tiled.groupBy("_node").agg(box, F.min("_low").alias("_low"), F.collect_list(F.struct("_box", "_low", what)).alias("_kids")))
        n = level.count()
        levels.append(_hint(level.select("_node", "_kids"), n))
        if n == 1:
            break
        rows, what, size = level.select("_box", "_low", F.col("_node").alias("_child")), "_child", fanout
    return levels


def _gap(x: Column, y: Column, box: Column) -> Column:
    """The distance from a point to a box."""
    dx = F.greatest(box["x0"] - x, x - box["x1"], F.lit(0.0))
    dy = F.greatest(box["y0"] - y, y - box["y1"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def k_nearest(points: DataFrame, things: DataFrame, distance: Callable[[Column, Column, Column], Column], k: int = 1, slack: float = 0.0, leaf: int = LEAF, fanout: int = FANOUT, digits: int | None = None) -> DataFrame:
    """_key and _near: the k nearest things of each point (all, if there are fewer), structs of d and item, nearest first; ties to
    the smaller first field of the item.

    points have _key, unique, and finite _x and _y; things _item and _box as tree() says.  distance(x, y, item) is never less
    than that to the item's box, or by no more than slack times the coordinates' size.  Without things no rows.  digits: distances
    that are equal when rounded to so many digits are ties; the distance returned is not rounded, and that of k = 1 is the least."""
    levels = tree(things, max(leaf, k), fanout)
    if not levels:
        return points.select("_key", F.array(F.struct(F.lit(0.0).alias("d"), F.lit(None).cast(things.schema["_item"].dataType).alias("item"))).alias("_near")).limit(0)
    x, y = F.col("_x"), F.col("_y")
    # Dealt by key at once, as the end needs them: a search costs more than its few bytes let adaptive execution expect.
    rows = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    rows = rows.select("_key", "_x", "_y", F.lit(0).cast("long").alias("_node"))
    for level in levels[:0:-1]:
        nearest = F.array_min(F.transform("_kids", lambda c: F.struct(_gap(x, y, c["_box"]).alias("d"), c["_child"].alias("c"))))
        rows = rows.join(level, "_node").select("_key", "_x", "_y", nearest["c"].alias("_node"))
    first = things.schema["_item"].dataType[0].name
    step = 10.0 ** -(digits or 0)
    ranked = lambda d: d if digits is None else F.rint(d / step)
    measured = F.transform("_kids", lambda c: F.struct(ranked(distance(x, y, c["_item"])).alias("d"), c["_item"].alias("item")))
    kth = F.get(F.array_sort(measured), F.lit(k - 1))
    rows = rows.join(levels[0], "_node").select("_key", "_x", "_y", kth.alias("_kth"))
    rows = rows.select("_key", "_x", "_y", F.coalesce("_kth.d", F.lit(float("inf"))).alias("_upto"), F.col("_kth.item")[first].alias("_last"), F.lit(0).cast("long").alias("_node"))
    # A box as far as the k-th so far can only hold a tie, and is met if it has a smaller id.
    gap, low = _gap(x, y, F.col("_c._box")), F.col("_c._low")
    most = F.col("_upto") if digits is None else (F.col("_upto") + 1) * step  # what rounds to the bound is half a step above it at most
    near = gap <= most + slack * (F.abs(x) + F.abs(y)) if slack or digits is not None else (gap < F.col("_upto")) | ((gap == F.col("_upto")) & F.coalesce(low <= F.col("_last"), F.lit(True)))
    own = ["_key", "_x", "_y", "_upto", "_last"]
    for level in levels[:0:-1]:
        rows = rows.join(level, "_node").select(*own, F.explode("_kids").alias("_c")).where(near).select(*own, F.col("_c._child").alias("_node"))
    rows = rows.join(levels[0], "_node").select(*own, F.explode("_kids").alias("_c")).where(near)
    d, item = F.col("_d"), F.col("_c._item").alias("item")
    rows = rows.withColumn("_d", distance(x, y, F.col("_c._item"))).where(ranked(d) <= F.col("_upto"))
    if digits is None:
        rows = rows.select("_key", F.struct(d.alias("d"), item).alias("_n"))
        if k == 1:
            return rows.groupBy("_key").agg(F.min("_n").alias("_n")).select("_key", F.array("_n").alias("_near"))
        return rows.groupBy("_key").agg(F.slice(F.array_sort(F.collect_list("_n")), 1, k).alias("_near"))
    rows = rows.select("_key", "_d", F.struct(ranked(d).alias("r"), item, d.alias("d")).alias("_n"))
    if k == 1:
        return rows.groupBy("_key").agg(F.min("_n").alias("_n"), F.min("_d").alias("_d")).select("_key", F.array(F.struct(d.alias("d"), F.col("_n.item").alias("item"))).alias("_near"))
    found = rows.groupBy("_key").agg(F.slice(F.array_sort(F.collect_list("_n")), 1, k).alias("_near"))
    return found.select("_key", F.transform("_near", lambda n: F.struct(n["d"].alias("d"), n["item"].alias("item"))).alias("_near"))


def one_nearest(points: DataFrame, things: DataFrame, distance: Callable[[Column, Column, Column], Column], least: int | None = None) -> DataFrame:
    """points (_key, _x and _y, which may be null) with _b, a struct of d and item: the nearest thing of each point, ties to the smaller first
    field of the item; null where _x or _y is not finite, or without things.

    Where points are many (``least``, else CELLS_FROM a thing), square cells, as many as things, find the CELL_THINGS things nearest to
    their middles, and a point meets those of its cell.  It is settled if it is nearer to one of them than any other thing can be; else, or
    outside the cells, it is searched for by k_nearest().  A thing's distance must not differ between two points by more than theirs."""
    there = finite(F.col("_x"), F.col("_y"))
    side = lambda f, c: f(F.col(f"_box.{c}"))
    n, x0, y0, x1, y1 = things.agg(F.count("*"), side(F.min, "x0"), side(F.min, "y0"), side(F.max, "x1"), side(F.max, "y1")).first()
    if not n:
        return points.withColumn("_b", F.lit(None).cast(f"struct<d: double, item: {things.schema['_item'].dataType.simpleString()}>"))
    w = max(math.sqrt((x1 - x0) * (y1 - y0) / n), max(x1 - x0, y1 - y0) / n)
    if w < 1e-9 * max(abs(x0), abs(y0), abs(x1), abs(y1), 1.0) or points.count() < (CELLS_FROM * n if least is None else least):
        found = k_nearest(points.where(there), things, distance).select(F.col("_key").alias("_own"), F.get("_near", F.lit(0)).alias("_b"))
        return points.join(found, F.col("_key").eqNullSafe(F.col("_own")), "left").drop("_own")
    x, y = F.col("_x"), F.col("_y")
    inside = there & x.between(x0 - w, x1 + w) & y.between(y0 - w, y1 + w)
    celled = points.withColumns({"_cx": F.when(inside, F.floor((x - x0) / w)), "_cy": F.when(inside, F.floor((y - y0) / w))})
    middle = [((F.col(c) + 0.5) * w + low).alias(f"_{p}") for c, low, p in (("_cx", x0, "x"), ("_cy", y0, "y"))]
    cells = celled.where("_cx is not null").select("_cx", "_cy").distinct().select(F.struct("_cx", "_cy").alias("_key"), *middle)
    near = k_nearest(cells, things, distance, CELL_THINGS)
    held = settled(near.select(F.col("_key._cx").alias("_hx"), F.col("_key._cy").alias("_hy"), F.transform("_near", lambda c: c["item"]).alias("_items"), F.get("_near", F.lit(CELL_THINGS - 1))["d"].alias("_rim")))
    met = celled.join(held, (F.col("_cx") == F.col("_hx")) & (F.col("_cy") == F.col("_hy")), "left")
    met = met.withColumn("_b", F.array_min(F.transform("_items", lambda i: F.struct(distance(x, y, i).alias("d"), i.alias("item")))))
    # No thing beyond the rim is nearer to the point than this.
    off = F.sqrt(F.pow(x - ((F.col("_cx") + 0.5) * w + x0), 2) + F.pow(y - ((F.col("_cy") + 0.5) * w + y0), 2))
    beyond = (F.coalesce("_rim", F.lit(float("inf"))) - off) * (1 - 1e-9) - 1e-9 * (F.abs(x) + F.abs(y))
    done = F.coalesce(F.col("_b.d") < beyond, ~there, F.lit(False))
    met = met.withColumn("_done", done)
    open_ = met.where(~F.col("_done")).select("_key", "_x", "_y")
    rest = k_nearest(open_, things, distance).select(F.col("_key").alias("_own"), F.get("_near", F.lit(0)).alias("_b"))
    late = open_.join(rest, F.col("_key").eqNullSafe(F.col("_own")), "left").select("_key", "_x", "_y", "_b")
    return met.where("_done").select("_key", "_x", "_y", "_b").unionByName(late)
