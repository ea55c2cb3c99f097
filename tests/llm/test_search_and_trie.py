"""The prefix trie, multi-index hashing and hard negatives against brute force, and their stated edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, hard_negatives, langid, multi_index, prefix_trie
from tidewake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


# --- 11 prefix trie -----------------------------------------------------------------------------------------------

def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    out = {}

    def visit(s):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves, saved = int(not children[s]), (len(members[s]) - 1) * words
        for child in children[s]:
            a, b = visit(child)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(members[s]) if len(made[c]) == len(s))
        key = min(members[s]), len(s)
        out[key] = (min(members[s[:-1]]) if s else None, len(members[s]), len(children[s]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        visit(())
    return out


def trie(spark, rows, **options):
    df = spark.createDataFrame(rows, TURNS).withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("i", F.lit(2))
    found = prefix_trie.nodes(df, **options).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(out) == len(found)
    return out


def odd_turns():
    """Null ids, turns, roles and texts, ties, repeated rows, copies, a very long text, prefixes of each other, absent bases and turnless
    conversations."""
    rnd = random.Random(1)
    rows = [(rnd.randrange(-30, 90), rnd.choice([None, *range(6)]), rnd.choice([None, "user", "a"]), rnd.choice([None, "", "x y", "z"])) for _ in range(250)]
    rows += [(1000 + i, t, "u", "same text") for i in range(45) for t in range(5)]
    rows += [(2000, t, "u", f"w{t % 3}") for t in range(40)] + [(2020, t, "u", f"w{t % 3}") for t in range(37)]
    return rows + [(None, 1, "u", "x"), (3001, 0, "u", "word " * 20_000)]


@pytest.mark.parametrize("options", [{"block": 4, "width": 4}, {}])
def test_trie_equals_brute_force(spark, options):
    """Blocks and sort keys of four make four levels of minima, and long sequences several rounds of ranks."""
    rows = odd_turns()
    assert trie(spark, rows, **options) == brute_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert trie(spark, []) == {}
    assert trie(spark, [(0, 0, "u", "a b")]) == brute_trie([(0, 0, "u", "a b")])
    gone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4)  # its base is absent, its only turn left out
    assert trie(spark, [(gone, 0, "u", "a")]) == {(gone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())}


def test_previous_and_next_smaller_values_over_levels(spark):
    rnd = random.Random(5)
    for n, block in ((1, 3), (3, 3), (200, 3)):
        l = [-1] + [rnd.choice([0, 0, 1, 2, 5]) for _ in range(n - 1)]  # noqa: E741
        blocks = prefix_trie.levels(spark.createDataFrame(list(enumerate(l)), "r long, l int"), n, [], ["l"], block)
        got = {r.r: (r.a, r.b) for r in prefix_trie.nearest_smaller(blocks, n, block).where("r > 0").collect()}
        for r in range(1, n):
            assert got[r] == (max(i for i in range(r) if l[i] < l[r]), min([i for i in range(r + 1, n) if l[i] < l[r]], default=n))


def test_sums_and_minima_of_intervals_over_levels(spark):
    rnd = random.Random(6)
    s, m = [rnd.randrange(9) for _ in range(120)], [rnd.randrange(99) for _ in range(120)]
    blocks = prefix_trie.levels(spark.createDataFrame([(i, *x) for i, x in enumerate(zip(s, m))], "r long, s long, m long"), 120, ["s"], ["m"], 3)
    asked = sorted({tuple(sorted((rnd.randrange(120), rnd.randrange(120)))) for _ in range(80)})
    got = prefix_trie.over_intervals(spark.createDataFrame(asked, "a long, b long"), blocks, ["s"], ["m"], 3).collect()
    assert {(r.a, r.b): (r.s, r.m) for r in got} == {(a, b): (sum(s[a : b + 1]), min(m[a : b + 1])) for a, b in asked}


# --- 12 multi-index hashing, 13 hard negatives ----------------------------------------------------------------------

def random_vectors(n, width, seed, copies=0):
    """Vectors in a few clusters, with very common copies."""
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((12, width))
    x = centres[rnd.integers(0, 12, n)] + 0.4 * rnd.standard_normal((n, width))
    x[:copies] = x[0]
    return x.astype(np.float32)


ODD_VECTORS = [(9001, None, 1), (9002, [float("nan")] * 8, 2), (9003, [math.inf] + [0.0] * 7, 1), (9004, [None] + [1.0] * 7, 3), (None, [1.0] * 8, 1), (9050, [1.0] * 8, None)]


def recall_and_scores(spark, x, k=20, **options):
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    found, exact, hit, total = defaultdict(list), x.astype(float), 0, 0
    for r in multi_index.nearest(df, k=k, **options).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id]) and r.score == pytest.approx(float(exact[r.query_id] @ exact[r.vec_id]), rel=1e-12)
    for q in range(0, len(x), 20):
        s = exact @ exact[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if i != q][:k]
        got = [v for v, _ in found[q]]
        assert len(got) == len(set(got)) == len(best) and q not in got
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        hit, total = hit + len(set(got) & set(best)), total + len(best)
    return hit / total


def test_recall_against_brute_force(spark):
    assert recall_and_scores(spark, random_vectors(1500, 24, 1), shard_rows=400, block_queries=30) >= 0.9
    scaled = random_vectors(1000, 24, 2) * np.random.default_rng(3).uniform(0.1, 5, (1000, 1)).astype(np.float32)  # norms differ
    assert recall_and_scores(spark, scaled) >= 0.9


def test_copies_are_found_in_order_of_ids(spark):
    """A third of all vectors are equal: their ties go to the smaller ids, in all shards together."""
    x = random_vectors(900, 16, 4, copies=300)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    found = defaultdict(list)
    for r in multi_index.nearest(rows, shard_rows=200).where("query_id < 300").orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    for q, got in found.items():
        top = [i for i in np.lexsort((np.arange(900), -np.round(x.astype(float) @ x[q].astype(float), 9))) if i != q]
        assert got[:5] == [int(i) for i in top[:5]]


def test_index_meets_every_code_within_the_radius():
    """The pigeonhole principle: nothing within the radius that search() reports is missed."""
    x = random_vectors(600, 12, 7).astype(float)
    most = float(np.linalg.norm(x, axis=1).max())
    rotations = multi_index.learned(multi_index.augmented(x, most, False))
    code = multi_index.codes(multi_index.augmented(x, most, False), rotations)
    index = multi_index.Index(code, x)
    for i in range(0, 600, 25):
        own = multi_index.codes(multi_index.augmented(x[i : i + 1], most, True), rotations)[0]
        rows, scores, radius = index.search(own, x[i], float(np.linalg.norm(x[i])) * most, 10)
        far = np.bitwise_count(code ^ own).sum(1)
        assert set(np.flatnonzero(far <= radius)) <= set(rows.tolist())
        assert np.allclose(scores, x[rows] @ x[i]) and len(set(rows.tolist())) == len(rows)
        for p in range(3):
            met = index.met(own, p, index.m)
            assert sorted(met.tolist()) == sorted(r for r in range(600) for j in range(index.m) if int(code[r, j] ^ own[j]).bit_count() == p)


def test_vectors_that_take_no_part(spark):
    good = [(i, v.tolist(), i % 3) for i, v in enumerate(random_vectors(120, 8, 8))]
    rows = spark.createDataFrame(good + ODD_VECTORS + [(9100, [0.0] * 8, 1), good[20], (40, [9.0] * 8, 2)], VECTORS)
    plain = spark.createDataFrame([*good], VECTORS)
    found = {(r.query_id, r.vec_id) for r in multi_index.nearest(rows).collect()}
    assert found and not {v for _, v in found} & {9001, 9002, 9003, 9004, 9100, None} and not {q for q, _ in found} - set(range(0, 120, 20)) - {9050 - 9050 % 20}
    assert len([1 for q, v in found if q == 20 and v == 40]) <= 1  # one vector an id
    some = spark.createDataFrame([(20, [1.0] * 8, 1), (21, [1.0] * 8, 2)], VECTORS)
    assert [tuple(r) for r in multi_index.nearest(some).collect()] == [(20, 1, 21, 8.0)]
    mined = {r.negative_id for r in hard_negatives.mined(rows).collect()} | {r.positive_id for r in hard_negatives.mined(plain).collect()}
    assert not mined & {9001, 9002, 9003, 9004, 9050, None}
    empty = spark.createDataFrame([], VECTORS)
    assert multi_index.nearest(empty).count() == 0 and hard_negatives.mined(empty).count() == 0
    assert hard_negatives.mined(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).count() == 0


def brute_negatives(x, labels, ids):
    v = np.floor(256 * x.astype(float)).astype(int)
    labels = [(c + 1) % 10 if i % 7 == 0 else c for i, c in zip(ids, labels)]
    out = []
    for a in range(len(ids)):
        if ids[a] % 50:
            continue
        s = v @ v[a]
        order = [b for b in np.lexsort((ids, -s)) if b != a]
        for p in [b for b in order if labels[b] == labels[a]][:5]:
            fits = [b for b in order if labels[b] != labels[a] and 50 * s[p] <= 100 * s[b] <= 95 * s[p]]
            out += [(ids[a], ids[p], r, ids[b], int(s[p]), int(s[b])) for r, b in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [(512, 16_384, 1024), (2, 150, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, bounds):
    """Also with many cells, and with groups cut into several shards and blocks; a third of the rows are copies."""
    for name, value in zip(("ANCHORS_A_PIVOT", "SHARD_ROWS", "BLOCK_ANCHORS"), bounds):
        monkeypatch.setattr(hard_negatives, name, value)
    x = random_vectors(1200, 16, 9, copies=400)
    labels = [(i * 7) % 10 if i % 3 else i % 4 for i in range(1200)]
    ids = list(range(1200))
    df = spark.createDataFrame([(i, v.tolist(), c) for i, v, c in zip(ids, x, labels)], VECTORS).withColumn("cell", F.lit("clash")).withColumn("d", F.lit(1))
    assert sorted(tuple(r) for r in hard_negatives.mined(df).collect()) == brute_negatives(x, labels, ids)


def test_negatives_of_huge_values_are_exact(spark):
    x = (random_vectors(150, 4, 10) * 1e9).astype(np.float32)
    labels = [i % 3 for i in range(150)]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, labels))], VECTORS)
    rows = hard_negatives.usable(df).collect()
    assert len(rows) == 150
    a = np.array([r.v for r in rows])
    assert hard_negatives._scores(a, a)[3, 7] == sum(int(p) * int(q) for p, q in zip(a[3], a[7]))


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_hard_negatives"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and got


# --- letters and answers ----------------------------------------------------------------------------------------------

def test_letters_of_large_alphabets_share_no_symbol(spark):
    """Two languages of 300 letters each, most of them rare: every letter is told apart, and the languages are."""
    first, second = [chr(0x4E00 + i) for i in range(300)], [chr(0x20000 + 7 * i) for i in range(300)]
    rnd = random.Random(2)
    said = lambda letters: "".join(rnd.choice(letters[:8]) if rnd.random() < 0.3 else rnd.choice(letters) for _ in range(1500))
    p = langid.Parser([("a", said(first)), ("b", said(second)), ("c", "plain letters " * 50)])
    for letters in (first, second, ["é", "z"]):
        written = [tuple(p.symbols(c).tolist()) for c in letters]
        assert len(set(written)) == len(letters) and all(written)
    bits = p.entropies([said(first), said(second), "plain letters", "".join(first[100:200])])
    assert [p.languages[i] for i in bits.argmin(1)] == ["a", "b", "c", "a"]
    assert (p.symbols(" a\u4e00 b\n\n\u4e01 ") == 0).sum() == 2


def test_answers_of_any_type(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank at noon and then it answers 42"
    docs = spark.createDataFrame([(1, f"some words before {text} and after"), (2, "nothing of the kind here"), (None, None)], "doc_id long, text string")
    for kind, answer in (("int", 42), ("double", 42.0), ("string", "42"), ("int", None)):
        bench = spark.createDataFrame([(7, text, answer), (None, text + " again", answer), (8, None, answer)], f"item_id long, text string, answer {kind}")
        found = decontaminate.leaks(docs, bench).collect()
        assert {r.doc_id for r in found} <= {1} and (kind == "double" or {(r.doc_id, r.item_id) for r in found} >= {(1, 7)})
