"""Small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidewake.functions import geo, scalars
from tidewake.operators import context, describe, ingest, layers, masks, motion, resample, segment, tasks, thin
from tidewake.sources import readers, sinks
from tidewake.streaming import positions


def track(spark, ts, **more):
    data = [{"mmsi": 1, "event_id": i, "ts_unix": t, "lat": 55.0 + i * 0.001, "lon": 10.0, **{k: v[i] for k, v in more.items()}} for i, t in enumerate(ts)]
    types = "mmsi long, event_id long, ts_unix long, lat double, lon double" + "".join(f", {k} {'string' if isinstance(v[0], str) else 'double'}" for k, v in more.items())
    return spark.createDataFrame(data, types)


def values(df, column):
    return [r[column] for r in df.orderBy("event_id").collect()]


def test_label_segments(spark):
    df = track(spark, [0, 10, 20, 4000, 4010], annotation=["", "STOP_START", "STOP_END", "", "GAP_START"])
    assert values(segment.label_segments(df, "mmsi"), "trip_idx") == [0, 0, 2, 3, 3]


def test_gap_is_strict(spark):
    assert values(segment.gap_segments(track(spark, [0, 1800, 3601]), "mmsi"), "seg") == [0, 0, 1]


def test_kinematics_of_few_points(spark):
    one = motion.kinematics(track(spark, [0]), ["mmsi"]).first()
    assert (one.speed_ms, one.accel_ms2, one.phase) == (0.0, 0.0, "stopped")
    two = motion.kinematics(track(spark, [0, 10]), ["mmsi"])
    assert values(two, "accel_ms2") == [0.0, 0.0]
    same = motion.kinematics(track(spark, [5, 5]), ["mmsi"])
    assert values(same, "speed_ms")[0] > 1e4


def test_greedy(spark):
    assert values(thin.greedy_thin(track(spark, [0, 3, 8, 15, 16, 24]), ["mmsi"], 8), "ts_unix") == [0, 8, 16, 24]


def test_denoise_skips_jumps_and_repeats(spark):
    df = track(spark, [0, 10, 10, 20]).withColumn("lat", F.when(F.col("event_id") == 1, 60.0).otherwise(F.col("lat")))
    assert values(thin.denoise(df, ["mmsi"]), "event_id") == [0, 2, 3]


def test_thinning_streams_trajectories_across_batches(spark):
    """Batches of three rows: what was kept last is carried on within a trajectory, and not into the next one."""
    track_of = lambda m, n: [(m, i, float(i * (3 + (m or 0)) % 1009), 55.0 + (i % 7) * 0.01, 10.0, f"r{i}") for i in range(n)]
    rows = [*track_of(1, 400), *track_of(2, 10), *track_of(None, 50)]
    df = spark.createDataFrame(rows, "mmsi long, event_id long, ts_unix double, lat double, lon double, `_new` string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        thinned = {tuple(r) for r in thin.greedy_thin(df, ["mmsi"], 20).collect()}
        calm = {tuple(r) for r in thin.denoise(df, ["mmsi"], 300.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def brute(keeps):
        out = set()
        for m in (1, 2, None):
            last = None
            for r in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])):
                if last is None or keeps(r, last):
                    out.add(r)
                    last = r
        return out

    metres = math.radians(1) * 6_371_000
    assert thinned == brute(lambda r, q: r[2] - q[2] >= 20)
    assert calm == brute(lambda r, q: r[2] != q[2] and abs(r[3] - q[3]) * metres / (r[2] - q[2]) <= 300.0)
    assert 10 < len(thinned) < len(rows) and 10 < len(calm) < len(rows)


def test_bucket_is_a_row_or_composite(spark):
    df = track(spark, [5, 59, 60, 61], sog=[None, 4.0, None, None])
    strict = {r.bucket: r.sog for r in resample.first_per_bucket(df, ["mmsi"], 60, ["sog"]).collect()}
    both = {r.bucket: r.sog for r in resample.first_per_bucket(df, ["mmsi"], 60, ["sog"], composite=True).collect()}
    assert strict == {0: None, 1: None} and both == {0: 4.0, 1: None}


@pytest.mark.parametrize(("n", "k"), [(1, 1), (10, 2), (30, 4), (100, 10)])
def test_last_n(spark, n, k):
    assert sum(values(tasks.last_n_mask(track(spark, range(n)), "mmsi"), "masked")) == k


def test_split_sizes(spark):
    starts = spark.range(10).select(F.col("id").alias("key"), F.lit(5).alias("start_ts"))
    got = {r.split: r["count"] for r in tasks.chronological_split(starts, "key").groupBy("split").count().collect()}
    assert got == {"train": 7, "val": 1, "test": 2}


def test_numbered_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert tasks.numbered(df, "x").where("_i != x + 1 or _n != 1000").count() == 0


def test_interpolation(spark):
    df = track(spark, range(4)).withColumn("lat", F.array(*map(F.lit, [0.0, 1.0, 9.0, 3.0]))[F.col("event_id")])
    assert values(tasks.interpolated(df.withColumn("masked", F.col("event_id") == 2), "mmsi"), "lat_hat") == [0, 1, 2, 3]
    assert values(tasks.interpolated(df.withColumn("masked", F.col("event_id") > 1), "mmsi"), "lat_hat") == [0, 1, 2, 3]
    assert values(tasks.interpolated(df.withColumn("masked", F.col("event_id") > 0), "mmsi"), "lat_hat") == [0, 0, 0, 0]


def test_errors(spark):
    r = tasks.errors(spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a"), (10.0, "a")], "error_m double, g string"), ["g"]).where("g is null").first()
    assert (r.mae_m, r.median_m, round(r.p90_m, 6), round(r.rmse_m**2, 6)) == (4.0, 2.5, 7.9, 28.5)


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        geo.angle_difference(F.lit(10.0), F.lit(350.0)), geo.angle_difference(F.lit(5.0), F.lit(200.0)), geo.geohash(F.lit(57.64911), F.lit(10.40744), 5), geo.geohash(F.lit(57.64911), F.lit(10.40744), 7),
        ingest.nav_label(F.lit("5.0")), ingest.nav_label(F.lit(13)), ingest.trip_category(F.lit("70.0")), ingest.trip_category(F.lit(" Cargo ")), describe.number(F.lit(0.25), 1),
    ).first()
    assert list(got) == [20.0, 165.0, "u4pru", "u4pruyd", "moored", None, "unknown", "cargo", "0.2"]


@pytest.mark.parametrize(("stop", "zone", "nm", "label"), [(True, False, 25, "open_anchorage"), (True, False, 7, "coastal"), (True, False, 3, "port_approach"), (False, True, 0.3, "berthed"), (False, False, 0.3, "port_approach"), (False, False, 25, "offshore")])
def test_port_label(spark, stop, zone, nm, label):
    assert spark.range(1).select(context.port_label(F.lit(stop), F.lit(zone), F.lit(float(nm)))).first()[0] == label


def test_majority(spark):
    df = spark.createDataFrame([(1, "car"), (1, "car"), (1, "bus"), (2, "car"), (2, "bus")], "k int, m string")
    assert {r.k: r.m for r in context.majority(df, "k", "m").collect()} == {1: "car", 2: "unknown"}


def test_kalman_and_subsample(spark):
    smooth = thin.kalman_smoothed(track(spark, range(30)), ["mmsi"]).collect()
    assert max(abs(r.lat - r.lat_s) for r in smooth) < 0.01
    assert thin.subsampled(track(spark, range(300)), ["mmsi"], 40).count() == 40


def test_empty_tables(spark):
    empty = track(spark, [0], annotation=[""]).limit(0)
    assert motion.kinematics(empty, ["mmsi"]).count() == segment.label_segments(empty, "mmsi").count() == thin.greedy_thin(empty, ["mmsi"], 8).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "7.txt").write_text("7,2008-02-02 15:36:08,116.51172,39.92123\nbad\n7,2008-02-02 15:46:08,0,0\n")
    r = readers.tdrive(spark, str(tmp_path / "7.txt")).collect()
    assert [(x.key, x.lat, x.lon, x.timestamp) for x in r] == [("7", 39.92123, 116.51172, 1201937768)]
    (tmp_path / "rome.txt").write_text("156;2014-02-01 00:00:00.739166+01;POINT(41.88 12.48)\n")
    r = readers.rome(spark, str(tmp_path / "rome.txt")).first()
    assert (r.key, r.lat, r.lon, r.timestamp) == ("156", 41.88, 12.48, 1391209200)
    (tmp_path / "new_abc.txt").write_text("37.75 -122.39 0 1213084687\n10 10 0 1\n")
    assert readers.cabspotting(spark, str(tmp_path / "new_abc.txt")).first().timestamp == 1213084687
    obs = "; ".join("37.9; 23.7; 1; 0; 0; {}".format(i * 0.04) for i in range(60))
    (tmp_path / "20181024_d1_0830_0900.csv").write_text(f"track_id; type; traveled_d; avg_speed; lat; lon; speed; lon_acc; lat_acc; time\n1; Car; 48.85; 9.77; {obs}\n")
    r = readers.pneuma(spark, str(tmp_path / "20181024_d1_0830_0900.csv")).orderBy("timestamp").collect()
    assert [x.timestamp for x in r] == [1540359000, 1540359001, 1540359002] and r[0].transport_mode == "car"


def test_sinks(spark, tmp_path):
    df = track(spark, range(5))
    sinks.points(df, str(tmp_path / "p"), by=["mmsi"], sort=["ts_unix"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    sinks.delimited(df.select("mmsi", "lon", "lat", "ts_unix"), str(tmp_path / "t"), " ", sort=["mmsi", "ts_unix"])
    assert [r.value.split(" ")[3] for r in spark.read.text(str(tmp_path / "t")).collect()] == list("01234")
    sinks.summary(segment.manifest(df, ["mmsi"]), str(tmp_path / "m"))
    assert sinks.stage(df, str(tmp_path), "s").count() == sinks.stage(df.limit(0), str(tmp_path), "s").count() == 5


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 02:00:00", 3.0), (2, "2024-01-01 00:00:30", 4.0)]
    df = spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    for name, build in (("trips", lambda s: positions.trips(s, "k", "t")), ("first", lambda s: positions.per_bucket(s, "k", "t", "v", "1 hour")), ("dedup", lambda s: positions.deduplicated(s, ["k"], "t"))):
        stream = build(positions.read(spark, str(tmp_path / "in"), df.schema))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "dedup" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("trips").collect()) == [1, 1, 2]
    assert sorted(r.v for r in spark.table("first").collect()) == [1.0, 3.0, 4.0]
    assert spark.table("dedup").count() == 2


def placed(spark, where):
    data = [(1, i, i * 10, lat, lon) for i, (lat, lon) in enumerate(where)]
    return spark.createDataFrame(data, "mmsi long, event_id long, ts_unix long, lat double, lon double")


def test_key_points_of_a_loop_are_those_far_from_its_start(spark):
    loop = placed(spark, [(0.0, 0.0), (1.0, 0.0), (3.0, 0.0), (1.0, 1.0), (0.0, 0.0)])
    assert values(tasks.key_point_mask(loop, "mmsi"), "masked") == [False, False, True, False, False]


def test_two_points_have_no_key_points(spark):
    assert values(tasks.key_point_mask(placed(spark, [(0.0, 0.0), (1.0, 0.0)]), "mmsi"), "masked") == [False, False]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 57])
def test_masks_have_their_sizes(spark, n):
    df = track(spark, range(n))
    assert sum(values(masks.random_mask(df, "mmsi"), "masked")) == max(1, round(n * 0.5))
    block = values(masks.block_mask(df, "mmsi"), "masked")
    at = [i for i, m in enumerate(block) if m]
    assert at == list(range(at[0], at[-1] + 1)) and max(1, round(0.2 * n)) <= len(at) <= max(1, round(0.3 * n))


@pytest.mark.parametrize("mode, size", [("spatial_random", 10), ("kinematic_group", 10), ("last_n", 3), ("key_point", 20)])
def test_masked_by_mode(spark, mode, size):
    """On a straight line every point is equally far from the chord: ties are all key points."""
    assert sum(values(masks.masked(track(spark, range(20)), "mmsi", F.lit(mode)), "masked")) == size


def test_modes_are_drawn_with_their_probabilities(spark):
    n = {r["m"]: r["count"] for r in spark.range(20000).groupBy(masks.mode_of(F.col("id")).alias("m")).count().collect()}
    assert set(n) == set(masks.MODES) and all(abs(n[m] / 20000 - p) < 0.02 for m, p in masks.MODES.items())


def test_downsampling_keeps_the_ends(spark):
    assert values(masks.downsampled(track(spark, range(30)), "mmsi", rate=1.0), "event_id") == [0, 29]
    assert masks.downsampled(track(spark, [5]), "mmsi", rate=1.0).count() == 1


def test_jitter_moves_by_the_radius(spark):
    df = track(spark, range(30))
    xy = lambda d: [(r.x, r.y) for r in d.select("event_id", *(c.alias(n) for c, n in zip(geo.mercator(F.col("lat"), F.col("lon")), "xy"))).orderBy("event_id").collect()]
    moved = xy(masks.jittered(df, "mmsi", rate=1.0))
    assert all(((a - c) ** 2 + (b - d) ** 2) ** 0.5 == pytest.approx(50, abs=1e-3) for (a, b), (c, d) in zip(xy(df), moved))


def test_prefixes_need_two_tokens_and_a_masked_row(spark):
    data = [(1, i, i, t, m) for i, (t, m) in enumerate([(7, False), (7, False), (8, False), (9, True)])]
    data += [(2, i, i, 7, i == 2) for i in range(3)] + [(3, i, i, i, False) for i in range(3)]
    df = spark.createDataFrame(data, "mmsi long, event_id long, ts_unix long, cell long, masked boolean")
    rows = masks.prefixes(df, "mmsi", "cell", ["ts_unix"]).collect()
    assert [(r.mmsi, r.tokens, [t.ts_unix for t in r.targets]) for r in rows] == [(1, [7, 8], [3])]


def test_extent(spark):
    df = spark.range(101).selectExpr("double(id) as x", "double(100 - 2 * id) as y")
    assert tuple(masks.extent(df, buffer=0.0).first()) == (0, -100, 100, 100)
    assert tuple(masks.extent(df, clip_pct=0.5, buffer=1.0).first()) == pytest.approx((-0.5, -100, 100.5, 100))


def test_vectors_are_gathered_or_the_read_fails(spark):
    rows, vectors = spark.range(3).toDF("k"), spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (5, 9.0)], "k long, v double")
    assert sorted(r.v for r in sinks.gathered(rows, vectors, ["k"]).collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="do not match"):
        sinks.gathered(rows, vectors.where("k <> 1"), ["k"]).collect()
    with pytest.raises(Exception, match="do not match"):
        sinks.gathered(rows, vectors.union(vectors), ["k"]).collect()


def test_epoch_by_type(spark):
    df = spark.sql("SELECT 90 AS a, timestamp_ntz'1970-01-02 00:00:01' AS b, '1970-01-01T00:01:00' AS c, 'x' AS e, timestamp_seconds(77) AS f")
    assert [df.select(readers.as_epoch(df, c, "yyyy-MM-dd'T'HH:mm:ss")).first()[0] for c in "abcef"] == [90, 86401, 60, None, 77]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("n", [20_000, 400_000])
def test_ranks_of_wide_rows_are_exact(spark, tmp_path, n, adaptive):
    """No row is lost or misnumbered when wide rows are ranked and written: sizes and rows see the same ranges."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = F.repeat(F.md5(F.col("id").cast("string")), 8)
        df = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % 104729).alias("start_ts"), F.col("id").alias("k"), wide.alias("payload"))
        tasks.chronological_split(df, "k").write.parquet(str(tmp_path / "split"))
        got = spark.read.parquet(str(tmp_path / "split"))
        shares = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
        assert shares == {"train": int(n * 0.7), "val": int(n * 0.15), "test": n - int(n * 0.7) - int(n * 0.15)}
        assert got.select("k", "payload").distinct().count() == n
        tasks.numbered(df, "start_ts", "k").write.parquet(str(tmp_path / "ranked"))
        rows = spark.read.parquet(str(tmp_path / "ranked")).select("start_ts", "k", "_i").toPandas().sort_values(["start_ts", "k"])
        assert (rows["_i"].to_numpy() == range(1, n + 1)).all()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_percentiles_of_groups(spark):
    data = [(g, float(v)) for g, n in ((None, 1), ("a", 4), ("b", 101)) for v in range(n)] + [("a", None)]
    rows = tasks.percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"m": 0.5, "p": 0.9}).collect()
    assert {r.g: (r.m, pytest.approx(r.p)) for r in rows} == {None: (0.0, 0.0), "a": (1.5, 2.7), "b": (50.0, 90.0)}


def test_nearest_place_however_far(spark):
    import random

    rnd = random.Random(5)
    places = [(i, f"p{i}", rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for i in range(25)] + [(100 + i, f"q{i}", 50 + i * 0.01, 3.0) for i in range(20)]
    at = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(150)] + [(200 + i, 50 + rnd.uniform(0, 0.3), 3 + rnd.uniform(0, 0.3)) for i in range(50)]
    points = spark.createDataFrame([*at, (900, None, 1.0)], "k long, lat double, lon double")
    layer = spark.createDataFrame(places, "port_id long, name string, lat double, lon double")
    got = {r.k: (r.port, r.nm) for r in context.nearest(points, layer, "k").collect()}
    assert got.pop(900) == (None, None)
    for k, lat, lon in at:
        d, _, name = min((math.hypot(lat - b, lon - c), i, n) for i, n, b, c in places)
        assert got[k] == (name, pytest.approx(d * 60))
    assert {(r.port, r.nm) for r in context.nearest(points, layer.limit(0), "k").collect()} == {(None, None)}


def test_layers_attributes(spark):
    tags = "amenity string, shop string, leisure string, tourism string, landuse string, ISO_SOV1 string, POL_TYPE string"
    df = spark.createDataFrame([("cafe", "x", None, None, "grass", "NOR1", "Territorial Sea"), (None, "x", "park", None, None, None, "200NM"), ("school", None, None, "hotel", None, "", "12NM"), ("bench", None, "park", "hotel", None, "X", None), ("bench", None, None, None, None, None, None)], tags)
    of = lambda c: [r[0] for r in df.select(c).collect()]
    assert of(layers.place_class(df)) == ["food_drink", "retail", "education", "recreation", "other"]
    assert of(layers.land_use(df)) == ["grass", "park", "school", "park", "bench"]
    assert of(layers.zone_state(df)) == ["NOR", "high_seas", "high_seas", "X", "high_seas"]
    assert of(layers.territorial(F.col("POL_TYPE"))) == [True, False, True, False, False]
    wet = spark.createDataFrame([(1.0, 0.5), (5.0, 4.0), (5.0, 0.3), (5.0, 0.05), (5.0, 0.0), (None, 1.0), (1.0, float("nan"))], "t double, p double")
    assert [r[0] for r in wet.select(layers.reanalysis_text(F.col("t"), F.col("p"))).collect()] == ["snow", "heavy rain", "moderate rain", "light rain", "dry", "unknown", "unknown"]


def test_rasters_take_the_nearest_node_and_the_last_beyond_the_ends(spark):
    nodes = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 2.0), (1.0, 0.0, float("nan")), (1.0, 1.0, None)], "lat double, lon double, z double")
    points = spark.createDataFrame([(1, 0.2, 0.49), (2, 0.1, 0.5), (3, -7.0, 9.0), (4, 0.9, 0.1), (5, 3.0, 3.0), (6, None, 1.0)], "k long, lat double, lon double")
    out = layers.raster_at(points, nodes, {"lat": (0.0, 1.0, 2), "lon": (0.0, 1.0, 2)}, ["z"])
    assert {r.k: r.z for r in out.collect()} == {1: 1.0, 2: 2.0, 3: 2.0, 4: None, 5: None, 6: None}


def test_united_rows_keep_those_without_a_city(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k long, city string"), spark.createDataFrame([(3, 1.5)], "k long, v double")
    assert sorted((r.k, r.city, r.v) for r in scalars.united(a, b).collect()) == [(1, "x", None), (2, None, None), (3, None, 1.5)]
