"""Tests of round 3's findings: each fails on the code before it."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import token_coder, tokens
from tidewake.operators import context, ingest, neighbours, roads, scan, segment, tasks
from tidewake.plans.queries import ORACLES, QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_poi_profile_broadcasts_no_pois_and_counts_copies(spark, tmp_path):
    points = spark.createDataFrame([(i, 10.0 * (i % 3), 0.0) for i in range(9)] + [(9, None, 1.0), (10, float("nan"), 1.0), (11, 9e6, 9e6)], "k long, x double, y double")
    pois = spark.createDataFrame([("a", 0.0, 0.0)] * 3 + [("b", 30.0, 40.0)] * 2 + [("c", 400.0, 400.0), ("a", -480.0, 0.0)], "category string, x double, y double")
    for name, df in (("points", points), ("pois", pois)):  # files, whose size on disk is small
        df.write.parquet(f"{tmp_path}/{name}")
    points, pois = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("points", "pois"))
    for mode in ("circle", "envelope"):
        out = context.poi_profile(points, pois, "k", mode=mode)
        assert "Broadcast" not in _plan(out)
        got = {r["k"]: r for r in out.collect()}
        assert len(got) == 12
        for k in range(9):
            x = 10.0 * (k % 3)
            for r in (50, 200, 500):
                want = {}
                for c, px, py in [("a", 0, 0)] * 3 + [("b", 30, 40)] * 2 + [("c", 400, 400), ("a", -480, 0)]:
                    d = max(abs(px - x), abs(py)) if mode == "envelope" else ((px - x) ** 2 + py**2) ** 0.5
                    if d <= r:
                        want[c] = want.get(c, 0) + 1
                text = "{" + ",".join(f'"{c}":{n}' for c, n in sorted(want.items(), key=lambda e: (-e[1], e[0]))) + "}"
                assert (got[k][f"poi_count_{r}m"], got[k][f"poi_categories_{r}m"]) == (sum(want.values()), text)
        assert all(got[k]["poi_count_500m"] == 0 and got[k]["poi_categories_500m"] == "{}" for k in (9, 10, 11))


def test_split_shares_are_decimals(spark):
    for n, sizes in ((170, {"train": 119, "val": 25, "test": 26}), (340, {"train": 238, "val": 51, "test": 51})):
        starts = spark.range(n).select(F.col("id").cast("string").alias("tid"), F.lit(0).cast("long").alias("start_ts"))
        assert {r["split"]: r["count"] for r in tasks.chronological_split(starts, "tid").groupBy("split").count().collect()} == sizes


def test_trajectory_profile_counts_positions_of_one_second(spark, tmp_path):
    """Two events of a user in one second, among others, as the SQL has it."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i // 2 * 60 + CASE WHEN i % 4 = 3 THEN 7 ELSE 0 END) AS ts, CAST(5 AS BIGINT) AS user_id,
      'view' AS event_type, i * 0.5 AS value, '' AS props FROM range(12) t(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = con.sql(ORACLES["trajectory_profile"]).df()
    got = QUERIES["trajectory_profile"](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert con.sql("SELECT count(*) > count(DISTINCT ts) FROM events").fetchall() == [(True,)]
    assert got["n_points"].tolist() == [12] and got.values.tolist() == want.values.tolist()


def test_edges_tied_but_for_rounding_go_to_the_smaller_id(spark):
    """Two edges as near as each other in decimals: 0.3 - 0.2 and 0.2 - 0.1 are different doubles."""
    corner = lambda x, y: f"named_struct('x', double({x}), 'y', double({y}))"
    line = lambda x: f"array({corner(x, -1)}, {corner(x, 1)})"
    edges = spark.sql(f"SELECT 1L AS edge_id, {line(0.1)} AS line UNION ALL SELECT 2L, {line(0.3)} UNION ALL SELECT 3L, {line(9)}")
    points = spark.createDataFrame([(i, 0.2, i / 10) for i in range(3)] + [(3, 8.9, 0.0), (4, 0.2, 0.1), (5, None, 0.1)], "k long, x double, y double")
    assert abs(0.3 - 0.2) < abs(0.1 - 0.2)
    got = {r.k: (r.edge_id, r.d) for r in roads.nearest_edge(points, edges, "k", digits=12).collect()}
    assert {k: e for k, (e, _) in got.items()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 1}
    assert all(abs(d - 0.1) < 1e-12 for k, (_, d) in got.items())


def test_points_of_one_place_are_searched_for_once(spark, monkeypatch):
    asked = []
    search = neighbours.k_nearest
    monkeypatch.setattr(neighbours, "k_nearest", lambda points, *a, **o: asked.append(points.count()) or search(points, *a, **o))
    edges = spark.sql("SELECT id AS edge_id, array(named_struct('x', double(id), 'y', 0D), named_struct('x', id + 0.5D, 'y', 0D)) AS line FROM range(10)")
    points = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("y"))
    got = roads.nearest_edge(points, edges, "k").collect()
    assert asked == [7] and sorted((r.k, r.edge_id, r.d) for r in got) == [(k, k % 7, 1.0) for k in range(200)]


def test_nearest_places_by_cells_equal_brute_force(spark):
    """Places spread, crowded and repeated; points among them, far off, on ties, and of no place: by cells and by the tree alone."""
    rnd = random.Random(7)
    spread = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(60)] + [(5 + rnd.uniform(0, 1e-3), 5.0) for _ in range(60)] + [(2.0, 2.0), (4.0, 2.0), (2.0, 2.0)]
    places = [(1000 - i, f"p{i}", a, o) for i, (a, o) in enumerate(spread)]
    asked = [(rnd.uniform(-1, 11), rnd.uniform(-1, 11)) for _ in range(300)] + [(3.0, 2.0), (2.0, 2.0), (500.0, -500.0), (5.0005, 5.0)]
    points = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(asked)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "k long, lat double, lon double")
    df = spark.createDataFrame(places, "port_id long, name string, lat double, lon double")
    want = {}
    for i, (a, o) in enumerate(asked):
        d, _, name = min((math.sqrt((a - la) ** 2 + (o - lo) ** 2), p, n) for p, n, la, lo in places)
        want[i] = (name, round(d * 60, 6))
    for least in (0, 10**9):
        rows = context.nearest(points, df, "k", least).collect()
        assert {r.k: (r.port, None if r.nm is None else round(r.nm, 6)) for r in rows} == want | {900: (None, None), 901: (None, None)}
        assert len(rows) == len(asked) + 2
    assert [r.port for r in context.nearest(points.where("k = 1"), df.limit(0), "k", 0).collect()] == [None]


def test_ranges_are_as_many_as_the_rows_need_and_stored(spark):
    """One trajectory of 3,000 rows and thirty of 40: the short ones do not get as many ranges as the long one, and scans read files."""
    df = spark.range(4200).select(
        F.when(F.col("id") < 3000, 0).otherwise(1 + F.col("id") % 30).alias("mmsi"), F.col("id").alias("event_id"), (F.col("id") * 7919 % 1009).alias("ts_unix"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("s"), F.lit(None).alias("_n"),
    )
    ranged = scan.with_ranges(df, ["mmsi"], rows=30)
    assert ranged.columns == [*df.columns, "range"] and ranged.schema["_n"].dataType == df.schema["_n"].dataType and ranged.inputFiles()
    sizes = ranged.groupBy("mmsi", "range").count().collect()
    assert len(sizes) <= 4200 / 30 + 31 and all(r.range is not None for r in sizes) and max(r["count"] for r in sizes) < 160

    def made(p, on):
        p = segment.point_index(segment.gap_segments(ingest.forward_filled(p, "mmsi", segment.ORDER, ["s"], on), "mmsi", 1, ranges=on), ["mmsi"], ranges=on)
        return sorted(map(repr, (tuple(r) for r in p.select("event_id", "s", "seg", "point_idx").collect())))

    assert made(ranged, "range") == made(df, None)


def test_words_are_encoded_once_and_without_parting(monkeypatch):
    """Odd marks, special tokens and boundaries; the library sees a word of letters once, whatever marks follow it, and nothing that parts words."""
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    library, asked = enc.tokenizer, []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(enc, "tokenizer", Spy())
    assert [len(x) > enc.width for x in enc.encode_narrow(["harbour, quay. harbour", "harbour. quay***", "quay harbour"], 2)] == [True] * 3
    assert sum(t.split().count("harbour") for t in asked) == 1 and not any(tokens.PARTING in t and "harbour" in t for t in asked)
    odd = ["", None, "a.", "..", ".a", " . ", "a..b. c", "x\n\n.y,", "é, É. a%%% b)*** --", "'s. it's, don't!", "<|endoftext|>. A<|startoftext|>,b", "1, 2. a1, a.1", "日本, ok.", "é, a.́ b", "a≠ b"]
    for texts in (odd, ["."], [""], ["a"], []):
        assert enc.encode(texts, 2) == [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]


def test_many_plain_words_pass_the_model_alone(monkeypatch):
    """The whole tokenizer sees no word of small Latin-1 letters, and the ids are its own; other letters and cases go through it."""
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    library, asked = enc.tokenizer, []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(enc, "tokenizer", Spy())
    letters = [c for c in map(chr, range(256)) if c.isalpha() and c.islower()]
    pairs = [a + b + c for a in letters for b in letters for c in ("", "e", "ñ")]
    others = ["ǆa", "ſt", "日本", "ΑΣ", "İx", "Ÿé", "ﬁn", "e\u0301a", "ŉ"]
    texts = [" ".join(pairs), "<|endoftext|> " + " ".join(p.title() for p in pairs), " ".join(others), "\n".join(others + pairs[:300])]
    assert enc.encode(texts, 2) == [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert not any(p in set(" ".join(asked).split()) for p in pairs)


def test_coder_follows_the_rows_counts():
    """Ids in no order take what their frequencies make them: 5 % more at most, the alphabet's 4 bytes an id included."""
    ids = np.random.default_rng(5).permutation(np.repeat(np.arange(20_000), 1 + 300_000 // (np.arange(20_000) + 10)))
    share = np.bincount(ids) / len(ids)
    least = -(share * np.log2(share)).sum() * len(ids) / 8 + 4 * 20_000
    data = token_coder.encode(ids)
    assert (token_coder.decode(data) == ids).all() and len(data) < 1.05 * least
