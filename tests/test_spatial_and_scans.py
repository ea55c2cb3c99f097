"""Nearest neighbours, zones, rasters, ranged scans and selection against brute force, with skewed and odd inputs."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewake.functions import geo, names, scalars
from tidewake.operators import context, ingest, layers, neighbours, roads, scan, segment, tasks, thin, zones

INF, NAN = math.inf, math.nan


# --- nearest neighbours ---------------------------------------------------------------------------------------------

def crowded(rnd, n):
    """Places in one crowd, copies of one place, a few across the world, and some without coordinates."""
    rows = [(i, 3 + rnd.gauss(0, 1e-4), 50 + rnd.gauss(0, 1e-4)) for i in range(n // 2)]
    rows += [(i, 7.0, 7.0) for i in range(n // 2, n // 2 + n // 4)]
    return rows + [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(n // 2 + n // 4, n)]


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("n", [0, 1, 3, 400])
def test_k_nearest_of_crowded_places(spark, k, n):
    rnd = random.Random(n)
    places = crowded(rnd, n)
    points = [(i, *rnd.choice([(rnd.uniform(-180, 180), rnd.uniform(-90, 90)), (3 + rnd.gauss(0, 1e-3), 50.0), (7.0, 7.0)])) for i in range(120)]
    things = spark.createDataFrame(places, "id long, x double, y double").select(F.struct("id", "x", "y").alias("_item"), F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")).alias("_box"))
    asked = spark.createDataFrame(points, "_key long, _x double, _y double")
    far = lambda x, y, item: F.sqrt(F.pow(x - item["x"], 2) + F.pow(y - item["y"], 2))
    got = {r._key: [(c.d, c.item.id) for c in r._near] for r in neighbours.k_nearest(asked, things, far, k, fanout=4).collect()}
    assert len(got) == (len(points) if n else 0)
    for key, x, y in points if n else []:
        want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), i) for i, a, b in places)[:k]
        assert [i for _, i in got[key]] == [i for _, i in want] and [d for d, _ in got[key]] == pytest.approx([d for d, _ in want])


def test_search_compares_few_pairs(spark):
    """In leaves of LEAF places a point meets one per cent of a thousand places, or fewer."""
    rnd = random.Random(3)
    things = spark.createDataFrame([(i, rnd.random(), rnd.random()) for i in range(1000)], "id long, x double, y double")
    things = things.select(F.struct("id", "x", "y").alias("_item"), F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")).alias("_box"))
    leaves = neighbours.tree(things)[0].select(F.size("_kids").alias("n")).toPandas().n
    assert leaves.sum() == 1000 and leaves.max() < 2 * neighbours.LEAF and leaves.min() == neighbours.LEAF


def test_places_and_points_without_coordinates(spark):
    points = spark.createDataFrame([(1, NAN, 1.0), (2, None, 1.0), (3, INF, 1.0), (4, 1.0, 1.0), (None, 2.0, 2.0)], "k long, lat double, lon double")
    ports = spark.createDataFrame([(1, "a", NAN, 1.0), (2, "b", 5.0, 5.0), (3, None, None, 0.0)], "port_id long, name string, lat double, lon double")
    got = {r.k: (r.port, r.nm) for r in context.nearest(points, ports, "k").where("k is not null").collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: ("b", pytest.approx(math.hypot(4, 4) * 60))}


def test_nearest_road_of_long_and_short_edges(spark):
    rnd = random.Random(4)
    lines = [(0, [(-100.0, 0.0), (100.0, 1.0)])] + [(i, [(x := rnd.uniform(-50, 50), y := rnd.uniform(-50, 50)), (x + rnd.gauss(0, 1), y + rnd.gauss(0, 1)), (x, y + 2)]) for i in range(1, 60)]
    lines += [(90, [(5.0, 5.0), (5.0, 5.0)]), (91, [(1.0, 1.0)]), (92, [])]
    edges = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in at]) for i, at in lines], "edge_id long, line array<struct<x: double, y: double>>")
    points = [(i, rnd.uniform(-80, 80), rnd.uniform(-80, 80)) for i in range(100)]
    got = {r.k: (r.edge_id, r.d) for r in roads.nearest_edge(spark.createDataFrame(points, "k long, x double, y double"), edges, "k").collect()}

    def to_piece(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    for k, x, y in points:
        d, _ = min((to_piece(x, y, a, b), i) for i, at in lines for a, b in zip(at, at[1:]))
        assert got[k][1] == pytest.approx(d)


def test_road_attributes_and_their_defaults(spark):
    line = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}]
    edges = spark.createDataFrame([(1, line, "['primary', 'link']", None, "50 mph; 30", "2;3", "true")], "edge_id long, line array<struct<x: double, y: double>>, highway string, name string, maxspeed string, lanes string, oneway string")
    points = spark.createDataFrame([(1, 0.5, 9.0, "x"), (2, None, 0.0, "y")], "k long, lat double, lon double, road_type string")
    got = {r.k: (r.road_type, r.road_name, r.speed_limit_kmh, r.road_lanes, r.road_oneway) for r in roads.with_roads(points, edges, "k").collect()}
    assert got == {1: ("primary", "", 50.0, 2, True), 2: ("unknown", "", None, 0, False)}
    bare = roads.with_roads(points, edges.select("edge_id", "line"), "k").where("k = 1").first()
    assert (bare.road_type, bare.speed_limit_kmh, bare.road_lanes, bare.road_oneway) == ("unclassified", None, 0, False)
    assert {r.road_type for r in roads.with_roads(points, edges.limit(0), "k").collect()} == {"unknown"}


# --- zones ------------------------------------------------------------------------------------------------------------

def ring_of(n, x, y, r, wave=0.0):
    return [(x + r * (1 + wave * math.sin(9 * t)) * math.cos(t), y + r * (1 + wave * math.sin(9 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]


def within(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def polygons_of(spark, rows):
    return spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, rings in rows], "zone_order long, rings array<array<struct<x: double, y: double>>>")


@pytest.mark.parametrize("most", [4, 32])
def test_holding_zones_equal_ray_casting(spark, most):
    """Wavy rings with holes and parts, a zone on round coordinates, and points on corners' coordinates."""
    rnd = random.Random(most)
    rows = [(1, [ring_of(300, 1, 2, 3, 0.2), ring_of(100, 1, 2, 1)]), (2, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]), (3, [ring_of(50, -3, 1, 0.5), ring_of(50, 5, 1, 0.5, 0.1)]), (4, [ring_of(200, 0, 0, 40, 0.1)])]
    points = [(i, rnd.uniform(-6, 8), rnd.uniform(-6, 8)) for i in range(1500)] + [(2000 + i, i / 2 + 0.25, 0.5 * i + 0.125) for i in range(9)]
    df = spark.createDataFrame(points, "k long, x double, y double")
    got = {(r._key, r._v.zone_order) for r in zones.holding(df, polygons_of(spark, rows), "k", ["zone_order"], most=most).collect()}
    assert got == {(k, z) for k, x, y in points for z, rings in rows if within(x, y, rings)}


def test_points_find_their_zones_alike_with_and_without_a_shuffle(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(5, [ring_of(300, 1, 2, 3, 0.2), ring_of(100, 1, 2, 1)]), (2, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]), (3, [ring_of(50, -3, 1, 0.5)]), (4, [ring_of(200, 0, 0, 40, 0.1)])]
    points = [(i, rnd.uniform(-6, 8), rnd.uniform(-6, 8)) for i in range(800)] + [(900 + i, i / 2 + 0.25, 0.5 * i + 0.125) for i in range(9)] + [(None, 1.0, 1.0), (950, None, 1.0), (951, NAN, 1.0), (952, 1.0, INF), (953, 500.0, 1.0)]
    df = spark.createDataFrame(points, "k long, x double, y double").withColumns({"_cx": F.lit(7), "_px": F.lit(8)})
    want = {k: min((z for z, rings in rows if x is not None and within(x, y, rings)), default=None) for k, x, y in points}
    for most in (zones.MAP_CELLS, 0):
        monkeypatch.setattr(zones, "MAP_CELLS", most)
        out = zones.in_polygon(df, polygons_of(spark, rows), "k", "zone_order", ["zone_order"])
        assert out.columns == ["k", "x", "y", "_cx", "_px", "zone_order"]
        assert {r.k: r.zone_order for r in out.collect()} == want and {(r._cx, r._px) for r in out.collect()} == {(7, 8)}
        assert not most or "hashpartitioning(k" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_zone_as_wide_as_an_ocean_is_few_rows(spark):
    n = 20_000
    cells = zones.covering(polygons_of(spark, [(1, [ring_of(n, -30, 10, 20, 0.05)])]), ["zone_order"])
    rows, edges, most = cells.agg(F.count("*"), F.sum(F.size("_e")), F.max(F.size("_e"))).first()
    assert most <= zones.CELL_EDGES and rows < n and edges < 3 * n


def test_odd_polygons_hold_nothing(spark):
    rows = [(1, [[(0.0, 0.0), (1.0, NAN), (1.0, 1.0)]]), (2, [[]]), (3, [[(0.0, 0.0), (1.0, 1.0)]])]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, NAN, 0.5)], "k long, x double, y double")
    assert zones.holding(points, polygons_of(spark, rows), "k", ["zone_order"]).count() == 0
    out = zones.in_polygon(points.withColumns({"zone_order": F.lit(7), "_v": F.lit(8), "_key": F.lit(9)}), polygons_of(spark, rows), "k", "zone_order", ["zone_order"])
    assert out.columns == ["k", "x", "y", "_v", "_key", "zone_order"] and {tuple(r)[3:] for r in out.collect()} == {(8, 9, None)}


def test_land_use_and_maritime_defaults(spark):
    square = [[[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]]]
    points = spark.createDataFrame([(1, 1.0, 1.0, "STOP_END"), (2, 9.0, 9.0, None)], "k long, lat double, lon double, annotation string")
    area = spark.createDataFrame([(*square, None)], "rings array<array<struct<x: double, y: double>>>, landuse string")
    of = lambda df: {r.k: r.land_use for r in df.collect()}
    assert of(zones.with_land_use(points, area, "k")) == {1: "other", 2: "unknown"} == of(zones.with_land_use(points, area.drop("landuse"), "k"))
    assert of(zones.with_land_use(points, None, "k")) == {1: "unknown", 2: "unknown"}
    bare = zones.with_maritime_context(points, "k").orderBy("k").collect()
    assert [(r.nearest_port_nm, r.nearest_port_name, r.port_proximity_label, r.in_port_zone, r.mpa_name, r.sea_area_name, r.eez_country_iso, r.in_territorial_sea) for r in bare] == [
        (None, "", "open_anchorage", False, "", "", "high_seas", False), (None, "", "offshore", False, "", "", "high_seas", False)]
    eez = spark.createDataFrame([(1, *square, "NORWAY", "Territorial")], "zone_order long, rings array<array<struct<x: double, y: double>>>, ISO_SOV1 string, POL_TYPE string")
    got = zones.with_maritime_context(points, "k", eez=eez, harbours=eez).where("k = 1").first()
    assert (got.eez_country_iso, got.in_territorial_sea, got.in_port_zone, got.port_proximity_label) == ("NOR", True, True, "offshore")
    named = zones.with_maritime_context(points.withColumn("city", F.lit("open_sea")), "k", seas=eez.withColumnRenamed("ISO_SOV1", "NAME"))
    assert {r.k: (r.city, r.sea_area_name) for r in named.collect()} == {1: ("norway", "NORWAY"), 2: ("open_sea", "")}


# --- rasters ----------------------------------------------------------------------------------------------------------

def test_nearest_node_of_an_uneven_axis(spark):
    nodes = [0.0, 1.0, 1.5, 4.0, 10.0]
    at = [-3.0, 0.0, 0.49, 0.5, 1.25, 2.75, 2.74, 7.0, 99.0, NAN, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(at)], "i long, x double").withColumn("n", layers.nearest_index(F.col("x"), F.array(*map(F.lit, nodes))))
    assert [r.n for r in df.orderBy("i").collect()] == [0, 0, 0, 1, 2, 3, 2, 4, 4, None, None]


def test_ranks_in_long_arrays(spark):
    values = sorted(random.Random(1).choices(range(3000), k=1000))
    df = spark.createDataFrame([(float(x),) for x in range(-5, 3005, 7)] + [(None,)], "x double").crossJoin(spark.createDataFrame([([float(v) for v in values],)], "v array<double>"))
    for r in df.select("x", scalars.rank_in(F.col("v"), F.col("x")).alias("n"), scalars.rank_in(F.array().cast("array<double>"), F.col("x")).alias("none")).collect():
        assert r.n == (0 if r.x is None else sum(v <= r.x for v in values)) and r.none == 0


@pytest.mark.parametrize("most", [3, 20_000])
def test_windows_in_blocks(spark, most):
    starts = [5, 10, 20, 40, 80, 160, 320, 640]
    points = spark.createDataFrame([(t,) for t in range(0, 1000, 3)], "ts_unix long").withColumns({"_i": F.lit(1), "_starts": F.lit(2), "w_start": F.lit(3)})
    got = layers.window_start(points, spark.createDataFrame([(s,) for s in starts], "w long"), most=most)
    assert set(got.columns) == {"ts_unix", "_i", "_starts", "w_start"}
    assert {r.ts_unix: r.w_start for r in got.collect()} == {t: max([s for s in starts if s <= t], default=5) for t in range(0, 1000, 3)}


def test_half_even_and_capitals(spark):
    x = [0.25, 0.35, -0.25, 12.5, None]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(geo.half_even(F.col("x"), 1).alias("a"), layers.depth(-F.col("x")).alias("b")).collect()
    assert [r.a for r in got] == [0.2, 0.4, -0.2, 12.5, None] and [r.b for r in got][:2] == [0.2, 0.4]
    weather = spark.createDataFrame([("OSLO", "1970-01-01", 0, 1.5, 0.0, 1.0, 2.0, 0)], "city string, date string, hour int, temperature_c double, precipitation_mm double, wind_speed_kmh double, wind_direction_deg double, weather_code int")
    points = spark.createDataFrame([(1, "Oslo", 5, 9.0), (2, None, 5, 9.0)], "k long, city string, ts_unix long, temperature_c double")
    assert {r.k: (r.temperature_c, r.weather_code, r.weather_description) for r in layers.hourly(points, weather, ["city"]).collect()} == {1: (1.5, 0, "clear sky"), 2: (None, -1, "unknown")}


# --- scans in ranges --------------------------------------------------------------------------------------------------

def odd_tracks(rnd, n):
    notes = ["", "STOP_START", "STOP_END", "GAP_START;X", "GAP_END", None]
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice([None, *range(0, 40_000, 7)]), rnd.choice([None, None, 1.0, 2.5]), rnd.choice(notes)) for i in range(n)]
    return rows + [(3, n + i, i * 100, None, "") for i in range(4)]


@pytest.mark.parametrize("rows", [10, 100, 10_000])
def test_ranged_scans_equal_plain_windows(spark, rows):
    """Null keys, null and equal times, and trajectories of many ranges, of one, and of none."""
    df = spark.createDataFrame(odd_tracks(random.Random(rows), 600), "mmsi long, event_id long, ts_unix long, s double, annotation string").withColumns({"_n": F.lit(1), "_was": F.lit(2), "_before": F.lit(3), "_first": F.lit(4)})
    ranged = scan.with_ranges(df, ["mmsi"], rows=rows)
    sizes = ranged.groupBy("mmsi", "range").count().collect()
    assert (max(r["count"] for r in sizes if r.range is not None) < 4 * rows + 40) if rows < 600 else all(r.range is None for r in sizes)

    def made(p, on):
        p = segment.label_segments(segment.gap_segments(ingest.forward_filled(p, "mmsi", segment.ORDER, ["s"], on), "mmsi", 600, ranges=on), "mmsi", 600, ranges=on)
        p = segment.point_index(p, ["mmsi", "seg"], ranges=on)
        return sorted(map(repr, (tuple(r) for r in p.select(*df.columns, "seg", "trip_idx", "point_idx").collect())))

    assert made(ranged, "range" if rows < 600 else None) == made(df, None)


@pytest.mark.parametrize("rows", [3, 1000])
def test_runs_of_consecutive_keys_cross_pieces(spark, rows):
    keys = [1, 1, 2, 2, 2, 2, 2, 1, None, None, 3, 1]
    data = [(f, i, k) for f in ("a", "b") for i, k in enumerate(keys if f == "a" else keys[::-1])]
    got = scan.runs(spark.createDataFrame(data, "file string, row long, k long"), "k", "file", "row", rows=rows)
    assert {(r.file, r.row): r.run for r in got.collect() if r.file == "a"} == {("a", i): n for i, n in enumerate([0, 0, 1, 1, 1, 1, 1, 2, 3, 3, 4, 5])}
    assert got.where("file = 'b'").agg(F.max("run")).first()[0] == 5


# --- selection --------------------------------------------------------------------------------------------------------

def test_bits_are_in_the_order_of_doubles(spark):
    rnd = random.Random(2)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0000000000000002, 0.9999999999999999, 8.0, 7.999999999999999, 1.7976931348623157e308, INF, -INF, NAN]
    xs += [rnd.uniform(-1, 1) * 10 ** rnd.uniform(-320, 308) for _ in range(400)] + [2.0**k for k in range(-1074, 1024, 9)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", tasks.ordered_bits(F.col("x")).alias("k")).collect():
        bits = struct.unpack(">q", struct.pack(">d", abs(r.x)))[0]
        assert r.k == ((2047 << 52) + 1 if r.x != r.x else -bits if r.x < 0 else bits)


@pytest.mark.parametrize("most", [tasks.BUCKET_ROWS, 500, 0])
def test_percentiles_equal_sparks_also_with_nan_and_infinities(spark, monkeypatch, most):
    """Buckets are sorted as soon as they are small, or refined to the last bit."""
    monkeypatch.setattr(tasks, "BUCKET_ROWS", most)
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2]), rnd.choice([1.0, 2.0, INF, -INF, NAN, rnd.gauss(0, 1), None])) for _ in range(1500)]
    rows += [("c", 1, 1.0), ("c", 1, 2.0), ("c", 1, 3.0), ("c", 1, INF), ("d", 1, NAN), ("e", 1, None)] + [("f", 1, 1 + i * 2.0**-50) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, h int, x double").withColumn("bucket", F.lit("clash")).withColumn("_x", F.lit(0))
    shares, sets = {"a": 0.25, "b": 0.5, "c": 0.9}, [[], ["g"], ["h"], ["g", "h"]]
    got = {(r._set, r.g, r.h): (r.a, r.b, r.c) for r in tasks.percentiles(df, ["g", "h"], "x", shares, sets).collect()}
    want = {}
    for i, by in enumerate(sets):
        for r in df.where("x is not null").groupBy(*by).agg(*(F.percentile("x", p).alias(n) for n, p in shares.items())).collect():
            want[i, r.g if "g" in by else None, r.h if "h" in by else None] = (r.a, r.b, r.c)
    assert got.keys() == want.keys()
    for k, values in want.items():
        for a, b in zip(got[k], values):
            assert a == b or (a != a and b != b) or a == pytest.approx(b, rel=1e-12)
    assert tasks.percentiles(df.limit(0), [], "x", shares).count() == 0


def test_ship_categories_by_kind_of_code(spark):
    for kind, value, want in (("int", 70, "cargo"), ("double", 70.9, "cargo"), ("string", "70.0", "unknown"), ("string", " 70 ", "cargo"), ("string", "Cargo", "cargo"), ("double", NAN, "unknown"), ("double", INF, "unknown"), ("double", None, "unknown")):
        assert spark.createDataFrame([(value,)], f"k {kind}").select(ingest.trip_category(F.col("k")).alias("c")).first().c == want


# --- smoothing --------------------------------------------------------------------------------------------------------

def smoothed(z, q=1e-4, r=1e-4):
    """The filter and the pass back with whole matrices."""
    import numpy as np

    f, h = np.eye(4), np.eye(2, 4)
    f[0, 2] = f[1, 3] = 1
    seen = [p is not None for p in z]
    if not any(seen):
        return [(None, None)] * len(z)
    x, p = np.array([*z[seen.index(True)], 0, 0], float), np.eye(4)
    pred, filt = [], []
    for at in z:
        x, p = f @ x, f @ p @ f.T + q * np.eye(4)
        pred.append((x, p))
        if at is not None:
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * np.eye(2))
            x, p = x + k @ (np.array(at) - h @ x), (np.eye(4) - k @ h) @ p
        filt.append((x, p))
    out = [filt[-1][0]]
    for t in range(len(z) - 2, -1, -1):
        out.append(filt[t][0] + filt[t][1] @ f.T @ np.linalg.inv(pred[t + 1][1]) @ (out[-1] - pred[t + 1][0]))
    return [tuple(s[:2]) for s in out[::-1]]


def test_kalman_streams_with_one_row_in_memory(spark):
    """Hidden rows at the start, in the middle and at the end, a trajectory that is all hidden, a null key, across batches."""
    rnd = random.Random(6)
    tracks = {m: [None if hidden(i) else (55 + i * 0.01 + rnd.gauss(0, 0.01), 10 - i * 0.02 + rnd.gauss(0, 0.01)) for i in range(n)] for m, n, hidden in ((1, 200, lambda i: i < 7 or i % 5 == 2 or i > 190), (2, 1, lambda i: False), (3, 9, lambda i: True), (None, 50, lambda i: i == 20))}
    rows = [(m, i, float(i), *(p or (None, NAN)), "x") for m, at in tracks.items() for i, p in enumerate(at)]
    df = spark.createDataFrame(rows, "mmsi long, event_id long, ts_unix double, lat double, lon double, _state string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = thin.kalman_smoothed(df, ["mmsi"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for m, at in tracks.items():
        mine = sorted((r.event_id, r.lat_s, r.lon_s) for r in got if r.mmsi == m)
        assert [i for i, *_ in mine] == list(range(len(at)))
        for (_, a, b), (x, y) in zip(mine, smoothed(at)):
            assert (a, b) == ((None, None) if x is None else (pytest.approx(x, abs=1e-9), pytest.approx(y, abs=1e-9)))


def test_bearings_of_missing_headings(spark):
    df = spark.createDataFrame([(1, 359.0), (2, None), (3, -46.0), (4, NAN)], "k int, h double").select("k", geo.bearing_label(F.nanvl(F.col("h"), F.lit(None).cast("double"))).alias("b"))
    assert [r.b for r in df.orderBy("k").collect()] == ["North", "unknown", "Northwest", "unknown"]


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "a long, _A long")
    assert names.free(df, "a", "b", "a") == ["__a", "b", "___a"]
