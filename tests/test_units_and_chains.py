"""Frozen units, records, stage chains and the readers of whole folders."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewake.functions import scalars
from tidewake.operators import context, masks, motion, resample, tasks, thin, units
from tidewake.plans import chain
from tidewake.sources import readers


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def unit_rows(spark, rows):
    return spark.createDataFrame([(s, d, n, i, float(v)) for s, d, n, i, v in rows], "split string, domain string, dataset string, k long, v double")


def test_units_are_written_once_and_mended_one_by_one(spark, tmp_path):
    root = str(tmp_path / "units")
    data = [("train", "urban", "007", i, i) for i in range(5)] + [("train", "maritime", "b", i, i) for i in range(4)] + [("test", "urban", "c", 1, 1)]
    first = {tuple(r) for r in units.freeze(unit_rows(spark, data), root).collect()}
    assert {r[:4] for r in first} == {("train", "urban", "007", 5), ("train", "maritime", "b", 4), ("test", "urban", "c", 1)}
    before = {f: os.path.getmtime(f) for f in files(root)}
    assert {tuple(r) for r in units.freeze(unit_rows(spark, data), root).collect()} == first
    assert {f: os.path.getmtime(f) for f in files(root)} == before  # nothing is written again
    hurt = next(f for f in files(f"{root}/data") if "dataset=b" in f)
    os.remove(hurt)
    units.freeze(unit_rows(spark, data), root)
    after = {f: os.path.getmtime(f) for f in files(f"{root}/data")}
    assert all(after[f] == t for f, t in before.items() if f in after and "dataset=b" not in f) and any("dataset=b" in f for f in after)
    assert units.units(spark, root, dataset="b").count() == 4 and units.units(spark, root, dataset=["007", "c"], split="train").count() == 5
    more = [*data, ("test", "urban", "d", 9, 9)]
    assert units.freeze(unit_rows(spark, more), root).count() == 4
    changed = [(s, d, n, i, v + 1) for s, d, n, i, v in data]
    units.freeze(unit_rows(spark, changed), root, overwrite=True)
    assert units.units(spark, root, dataset="007").agg(F.sum("v")).first()[0] == sum(range(1, 6)) and units.units(spark, root, dataset="d").count() == 1
    plan = units.units(spark, root, domain="maritime")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan
    assert units.freeze(unit_rows(spark, data).limit(0), str(tmp_path / "none")) is None


def test_ordinals_of_a_hot_dataset(spark):
    rows = [("hot", i) for i in range(3000)] + [("b", i) for i in range(3)] + [(None, 1)]
    random.Random(1).shuffle(rows)
    got = units.ordinals(spark.createDataFrame(rows, "g string, k long"), "g", ["k"])
    assert {(r.g, r.k): r.ordinal for r in got.collect()} == {(g, k): 0 if g is None else k for g, k in rows}


def test_frozen_trajectories_and_records(spark):
    rows = [(m, i, i * 10, 55 + i * 0.001 * m, 10 + i * 0.002, f"d{m % 2}", "urban") for m in (1, 2, 3, 4) for i in range(m * 30)] + [(9, 0, 5, 1.0, 2.0, "d1", "urban")]
    points = spark.createDataFrame(rows, "m long, event_id long, ts_unix long, lat double, lon double, dataset string, domain string")
    frozen = units.frozen(points, "m", ("dataset", "domain"), max_len=100)
    got = {r.m: r for r in frozen.collect()}
    assert {m: r.traj_len for m, r in got.items()} == {1: 30, 2: 60, 3: 90, 4: 100, 9: 1}
    for m, r in got.items():
        n = r.traj_len
        assert len(r.x) == len(r.y) == len(r.tau) == len(r.recovery) == n and sum(r.recovery) == max(1, round(n * 0.5)) and sum(r.prediction) == min(10, max(1, round(n * 0.15)))
        assert r.prediction[-1] and (r.lat0, r.lon0, r.t0) == ((1.0, 2.0, 5) if m == 9 else (55.0, 10.0, 0))
    still = frozen.select("m", "x", "y").withColumnsRenamed({"x": "pred_x", "y": "pred_y"})
    made = {r.m: r for r in units.records(frozen, still, "m", max_len=90).collect()}
    assert {m: r.uid for m, r in made.items()} == {1: "d1#0", 2: "d0#0", 3: "d1#1", 9: "d1#2"}  # the fourth is too long, but keeps its place
    r = made[3]
    assert r["at"] == list(range(80, 90)) and r.err_m == pytest.approx([0.0] * 10) and r.true_lat[0] == pytest.approx(55 + 80 * 0.003)


def test_chain_resumes_and_reruns_only_what_changed(spark, tmp_path):
    folder, ran = str(tmp_path / "chain"), []

    def stage(name, **settings):
        def run(df, o):
            ran.append(name)
            if o.get("fail"):
                raise RuntimeError("killed")
            return df.withColumn(name, F.lit(o.get("v", 0)))

        return chain.Stage(name, run, settings, {"most": F.max("id")})

    rows = spark.range(10)
    with pytest.raises(RuntimeError):
        chain.run(rows, [stage("a"), stage("b"), stage("c", fail=True)], folder)
    assert ran == ["a", "b", "c"]
    out, said = chain.run(rows, [stage("a"), stage("b"), stage("c")], folder)
    assert ran == ["a", "b", "c", "c"] and out.columns == ["id", "a", "b", "c"] and said["a"] == {"n_rows": 10, "most": 9} and said["c"]["n_rows"] == 10
    chain.run(rows, [stage("a"), stage("b", v=5), stage("c")], folder)
    assert ran[4:] == ["b", "c"]
    out, _ = chain.run(rows, [stage("a"), stage("b", v=5), stage("c")], folder, only=["a", "c"])
    assert ran[6:] == ["c"] and out.columns == ["id", "a", "c"]
    chain.run(rows, [stage("a"), stage("b", v=5), stage("c")], folder, version="another input")
    assert ran[7:] == ["a", "b", "c"]
    out, _ = chain.run(rows, [stage("a"), stage("b"), stage("c")], folder, tidy=True)
    assert len([f for f in os.listdir(folder) if not f.endswith(".summary")]) == 1 and out.count() == 10
    with pytest.raises(ValueError):
        chain.run(rows, [stage("a")], folder, only=["x"])


def test_configured_datasets(spark, tmp_path):
    listed = [{"source": "range", "input": 5, "output": str(tmp_path / "one")}, {"source": "range", "input": 7, "output": str(tmp_path / "two")}]
    (tmp_path / "c.json").write_text(json.dumps(listed))
    calls = []

    def stages(entry):
        return [chain.Stage("double", lambda df, o: (calls.append(1), df.withColumn("x", F.col("id") * 2))[1], {}, chain.spread("x"))]

    for _ in range(2):
        said = chain.configured(spark, str(tmp_path / "c.json"), {"range": lambda s, e: s.range(e["input"])}, stages, str(tmp_path / "work"))
    assert len(calls) == 2 and said[str(tmp_path / "two")]["double"] == {"n_rows": 7, "x_min": 0, "x_mean": 6.0, "x_max": 12}
    assert spark.read.parquet(str(tmp_path / "one")).count() == 5


def test_geolife_folders(spark, tmp_path):
    head = "\n".join(["Geolife trajectory", "WGS 84", "Altitude is in Feet", "Reserved 3", "0,2,255,My Track,0,0,2,8421376", "0"])
    line = lambda lat, time: f"{lat},116.3,0,492,39744.1,2008-10-23,{time}"
    for user, plts in (("000", {"a": ["02:00:00", "02:10:00", "03:30:00"], "b": ["05:00:00"]}), ("001", {"a": ["02:00:00"]})):
        at = tmp_path / user / "Trajectory"
        at.mkdir(parents=True)
        for stem, times in plts.items():
            at.joinpath(f"{stem}.plt").write_text("\n".join([head, *(line(10.0 if stem == "b" else 40.0, t) for t in times), "bad,line"]) + "\n")
    (tmp_path / "000" / "labels.txt").write_text("Start Time\tEnd Time\tTransportation Mode\n2008/10/23 01:50:00\t2008/10/23 02:20:00\tbus\n2008/10/23 01:00:00\t2008/10/23 09:00:00\twalk\nnonsense\n")
    trips = readers.geolife_trips(readers.geolife(spark, f"{tmp_path}/*/Trajectory/*.plt"), readers.geolife_labels(spark, f"{tmp_path}/*/labels.txt"))
    got = sorted((r.trajectory_id, r.point_idx, r.transport_mode) for r in trips.collect())
    assert got == [("geolife_000_a_0", 0, "bus"), ("geolife_000_a_0", 1, "bus"), ("geolife_000_a_1", 0, "walk"), ("geolife_001_a_0", 0, "unknown")]


def test_contained_in_one_of_very_many_intervals(spark):
    rnd = random.Random(4)
    iv = [(rnd.choice([1, 2]), t := rnd.randrange(-5000, 10**6), t + rnd.choice([0, 1, 5, 300, 70_000]), f"l{i}", i) for i in range(2000)] + [(1, 10, 5, "turned", -1)]
    seg = [(i, rnd.choice([1, 2, 3]), s := rnd.randrange(-6000, 10**6), s + rnd.randrange(0, 60)) for i in range(500)]
    intervals = spark.createDataFrame(iv, "u long, t0 long, t1 long, label string, label_order long")
    got = {r.seg_id: r.label for r in context.contained(spark.createDataFrame(seg, "seg_id long, u long, s long, e long"), intervals, "u").collect()}
    for i, u, s, e in seg:
        assert got[i] == min(((o, label) for k, a, b, label, o in iv if k == u and a <= s and e <= b), default=(0, "unknown"))[1]
    assert {r.label for r in context.contained(spark.createDataFrame(seg, "seg_id long, u long, s long, e long"), intervals.limit(0), "u").collect()} == {"unknown"}


def test_nyc_labels(spark):
    points = spark.createDataFrame([(t, i * 400_000_000, 1.0 + i, 2.0) for t in (1, 2, 3, 4) for i in range(5)], "traj_id long, time long, lat double, lon double")
    moves = spark.createDataFrame([("1", 3), ("1", 3), ("1", 2), ("2", 0), ("2", 5), ("3", 99)], "tid string, label int")
    got = readers.nyc_trips(points, moves).collect()
    assert {r.trajectory_id: r.transport_mode for r in got} == {"nyc_1": "car", "nyc_2": "unknown", "nyc_3": None, "nyc_4": None}
    assert sorted(r.timestamp for r in got if r.trajectory_id == "nyc_1") == [0, 1] and {r.transport_mode for r in readers.nyc_trips(points, None).collect()} == {None}


@pytest.mark.parametrize("rows", [7, 1_000_000])
def test_simulated_trips_that_recur(spark, tmp_path, rows):
    data = [(1, 55.0, 10.0, float(t)) for t in range(0, 40, 4)] + [(2, 56.0, 10.0, t + 0.5) for t in range(0, 30, 3)] + [(1, 57.0, 10.0, float(t)) for t in range(100, 120, 5)]
    spark.createDataFrame(data, "tripid long, lat double, lon double, ts double").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = readers.simulated_trips(spark, str(tmp_path / "p"), "sim", 8.0, rows).orderBy("trajectory_id", "point_idx").collect()
    assert [(r.trajectory_id, r.timestamp) for r in got if r.trajectory_id != "sim_2"] == [("sim_1", t) for t in (0, 8, 16, 24, 32)] + [("sim_1_1", t) for t in (100, 110)]
    assert [r.timestamp for r in got if r.trajectory_id == "sim_2"] == [0, 9, 18, 27] and [r.point_idx for r in got if r.trajectory_id == "sim_1_1"] == [0, 1]
    assert math.isclose(sum(r.lat for r in got), 55 * 5 + 56 * 4 + 57 * 2)


def test_ais_headers(spark, tmp_path):
    (tmp_path / "dma.csv").write_text("# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,Name\n01/02/2020 00:00:00,Class A,219000001,55.5,10.25,,VESSEL\n01/02/2020 00:00:01,Class A,x,1e1,10,3.5,\n")
    df = readers.ais_csv(spark, str(tmp_path / "dma.csv"))
    assert dict(df.dtypes) == {"# Timestamp": "string", "Type of mobile": "string", "MMSI": "bigint", "Latitude": "double", "Longitude": "double", "SOG": "double", "Name": "string"}
    assert [tuple(r)[2:] for r in df.collect()] == [(219000001, 55.5, 10.25, None, "VESSEL"), (None, 10.0, 10.0, 3.5, None)]
    assert [r.t for r in df.select(readers.as_epoch(df, "# Timestamp", "dd/MM/yyyy HH:mm:ss").alias("t")).collect()] == [1580515200, 1580515201]


def test_own_columns_that_look_like_helpers_stay(spark):
    rows = [(m, i, 10 * i, 55.0 + i, 10.0, i % 3 == 0, "a", "b", 7, 8) for m in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "mmsi long, event_id long, ts_unix long, lat double, lon double, masked boolean, _i string, _n string, _v int, _draw int")
    for made in (
        masks.random_mask(df, "mmsi"), masks.block_mask(df, "mmsi"), masks.downsampled(df, "mmsi"), masks.jittered(df, "mmsi"), masks.within_length(df, "mmsi"), tasks.normalised(df, "mmsi"), tasks.last_n_mask(df, "mmsi"),
        tasks.key_point_mask(df, "mmsi"), tasks.interpolated(df, "mmsi"), tasks.token_runs(df, "mmsi", "_draw"), motion.kinematics(df, ["mmsi"]), resample.one_per_bucket(df, ["mmsi"], 5), resample.every_kth(df, ["mmsi"], 2),
        thin.subsampled(df, ["mmsi"], 4), tasks.chronological_split(df.withColumn("start_ts", F.col("ts_unix")), "event_id"),
    ):
        assert {(r["_i"], r["_n"], r["_v"], r["_draw"]) for r in made.collect()} == {("a", "b", 7, 8)}


def test_units_of_scalars(spark):
    r = spark.range(1).select(scalars.celsius(F.lit(300.15)).alias("c"), scalars.millimetres(F.lit(0.25)).alias("mm"), *(c.alias(n) for n, c in zip(("lat", "lon"), scalars.denormalised(F.lit(0.5), F.lit(-1.0), F.lit(2.0), F.lit(55.0), F.lit(10.0))))).first()
    assert (round(r.c, 9), r.mm, r.lat, r.lon) == (27.0, 250.0, 56.0, 8.0)


def test_standardised_offsets_come_back(spark):
    rows = [(m, i, i * (4 * m), 55 + i * 0.001 * m, 10 + (i * i % 7) * 0.002, f"d{m % 2}", "urban") for m in (1, 2, 3) for i in range(20)] + [(8, 0, 5, 1.0, 2.0, "d1", "urban")]
    points = spark.createDataFrame(rows, "m long, event_id long, ts_unix long, lat double, lon double, dataset string, domain string")
    frozen = units.frozen(points, "m", ("dataset", "domain"))
    out = units.standardised(frozen, "m")
    lat, lon = units.restored(F.get("lon_n", F.lit(7)), F.get("lat_n", F.lit(7)))
    got = {r.m: r for r in out.select("m", "uid", "dt", "at", lat.alias("lat"), lon.alias("lon")).collect()}
    assert {m: r.uid for m, r in got.items()} == {1: "d1#0", 2: "d0#0", 3: "d1#1"}  # the one of a single row is hidden whole
    for m, r in got.items():
        assert (r.lat, r.lon) == (pytest.approx(55 + 7 * 0.001 * m), pytest.approx(10.0)) and r.dt == pytest.approx([0.0] + [min(15.0, 4.0 * m)] * 19) and r["at"] == [17, 18, 19]
    hidden = {r.m: r for r in units.hidden(frozen, "m").collect()}
    assert hidden[1]["at"] == [17, 18, 19] and len(hidden[1].tau) == 3 and hidden[8]["at"] == [0]
