"""The llm operators against brute force, round trips and their stated edge cases."""

import collections
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
import xxhash
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, html_wrappers, langid, line_dedup, maxscore, packing, quality, simhash, token_coder, token_files, toxicity
from tidewake.llm.common import table
from tidewake.llm.tokens import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SAYS = ["the cat sat on the mat and looked at the dog", "a long walk by the river in the early morning light", "ships leave the port when the tide is high enough"]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", " \n\t ", "one", "one two", "x " * 30_000, "same text here for all", "same text here for all", "naïve Ünïcode ẞ İ 日本 😀", "12 + 34 = 46"]


def odd(spark):
    """Null, empty, short, very long and repeated texts, a null id, a repeated row, and a column with a clashing name."""
    rows = docs_of(spark, ODD).unionByName(docs_of(spark, ["no id"], [None])).unionByName(docs_of(spark, ["one"], [3]))
    return rows.withColumn("score", F.lit(7)).withColumn("fp", F.lit("x"))


# --- 10 near-duplicates -------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_classes(pairs):
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        low[find(i)] = min(low.get(find(i), math.inf), math.inf if d is None else d)
    return [low[find(i)] for i in range(len(pairs))]


def test_fingerprints_and_classes(spark):
    rnd = random.Random(1)
    texts = [rnd.choice(SAYS) + " " + " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 3))) for _ in range(120)] + ODD[:5] + ODD[6:]
    got = sorted(simhash.classes(docs_of(spark, texts)).collect(), key=lambda r: r.doc_id)
    pairs = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert [r.fp % 2**64 for r in got] == [f for _, f in pairs]
    assert [r.component_id for r in got] == brute_classes(pairs)


@pytest.mark.parametrize("limit", [2, 512])
def test_links_of_close_fingerprints(spark, monkeypatch, limit):
    """Every pair within two bits is linked, with crowded anchors too."""
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        fps |= {f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(6)}
    centre = rnd.getrandbits(64)
    fps |= {centre ^ 1 << b for b in range(64)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "ANCHOR_LIMIT", limit)
    a = np.array(fps, np.uint64).view(np.int64)
    rows = simhash.anchors(spark.createDataFrame([(int(x),) for x in a], "fp long")).toPandas().sort_values("anchor")
    import pyarrow as pa

    out = list(simhash._per_anchor(iter([pa.RecordBatch.from_pandas(rows[i : i + 97], preserve_index=False) for i in range(0, len(rows), 97)])))
    u = [x for b in out for x in b.column(0).to_pylist()]
    v = [x for b in out for x in b.column(1).to_pylist()]
    hot = sorted({x for x, y in zip(u, v) if y is None})
    edges = [(x, y) for x, y in zip(u, v) if y is not None]
    if hot:
        fine = next(simhash._fine(iter([pa.RecordBatch.from_arrays([pa.array(hot)], names=["u"])]))).to_pandas()
        edges += [(int(f), int(g.fp.min())) for _, g in fine.groupby("word") for f in g.fp]
    assert bool(hot) == (limit == 2)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = [got.get(int(x), int(x)) for x in a]
    want = brute_classes(list(enumerate(fps)))
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_near_dedup_keeps_one(spark):
    kept = simhash.deduplicated(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 6, 8, 9]
    assert simhash.deduplicated(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [512, 3])
def test_groups_keep_every_candidate(monkeypatch, limit):
    monkeypatch.setattr(simhash, "ANCHOR_LIMIT", limit)
    rng = np.random.default_rng(4)
    anchor = np.sort(np.concatenate([rng.integers(0, 200, 400), np.full(250, 77)]))
    fp = rng.integers(0, 1 << 62, len(anchor)) & np.where(rng.random(len(anchor)) < 0.5, 0xFFFFF, -1)
    key = np.arange(len(anchor))
    rows = pa.table({"anchor": anchor, "key": key, "fp": fp})
    out = pa.Table.from_batches(list(simhash._groups(iter(rows.to_batches(97))))).to_pylist()
    members = {}
    for r in out:
        members.setdefault(r["anchor"], {r["rep"]}).add(r["key"])
        assert r["near"] == ((int(fp[r["rep"]]) ^ int(fp[r["key"]])).bit_count() <= simhash.NEAR_BITS)
    for i in range(len(key)):
        for j in range(i):
            if anchor[i] == anchor[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= simhash.NEAR_BITS:
                assert {i, j} <= members[anchor[i]]


def test_near_dedup_joins_near_copies(spark):
    rnd = random.Random(11)
    text = lambda: [f"w{rnd.randrange(4000)}" for _ in range(160)]
    texts = []
    for _ in range(30):
        base = text()
        for edits in (0, 1, 2, 3):  # of 156 shingles, three edits change 15: Jaccard 0.82 or more with the base
            words = list(base)
            for at in rnd.sample(range(160), edits):
                words[at] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[:100] + text()[:60]))  # shares a part, but is no copy
    gram = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [gram(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    low = list(range(len(texts)))
    for _ in range(5):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert len(links) >= 90
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(low))
    assert sorted(r.doc_id for r in simhash.deduplicated(docs_of(spark, texts)).collect()) == sorted(set(low))


# --- 2 packing, 8 files -------------------------------------------------------------------------------------------

def test_chunks_encode_as_whole_texts():
    rnd = random.Random(3)
    letters = "aAbzÉéßİıΣσñ'’sStTreD .,!*#|<>\t\r\n\x0b\x85　́‍12٣日😀&%\x00\x1c"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["a<|endoftext|>b", "<|ENDOFTEXT|>", "we'LL don't"]
    e = encoder(tokenizer_path())
    for t, x in zip(texts, e.encode(texts, 2)):
        assert np.frombuffer(x, "<u4").tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2], repr(t)


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, length):
    docs = odd(spark)
    pieces = packing.packed(docs.repartition(3), length).collect()
    e = encoder(tokenizer_path())
    want = sorted(e.encode([r.text for r in docs.collect()], 1))
    by: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert len(p.ids) == 4 * p.length and p.offset + p.length <= length
        by.setdefault(p.sequence_id, []).append(p)
    for s, ps in by.items():
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        assert s == max(by) or sum(p.length for p in ps) == length
    whole, texts = b"".join(bytes(p.ids) for s in sorted(by) for p in by[s]), []
    for p in (p for s in sorted(by) for p in by[s]):
        texts.append(bytes(p.ids)) if p.start == 0 else texts.append(texts.pop() + bytes(p.ids))
    assert sorted(texts) == want and len(whole) == sum(map(len, want))
    rows = packing.sequences(packing.packed(docs, length), length).collect()
    assert all(len(r.tokens) == length or len(r.tokens) & (len(r.tokens) - 1) == 0 for r in rows)
    assert packing.packed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [65535] * 9000, list(range(5000)) * 2, np.random.default_rng(0).integers(0, 65536, 20000), np.random.default_rng(1).integers(0, 1 << 32, 200_000), np.random.default_rng(2).zipf(1.2, 300_000) % 100_000])
def test_coder_round_trip(ids):
    """Also with more distinct ids than an alphabet holds, and with ids of 32 bits."""
    data = token_coder.encode(np.array(ids, np.int64))
    assert token_coder.decode(data).tolist() == list(ids)


@pytest.mark.parametrize(("blocks", "lanes"), [(1, 3072), (98, 3072), (98, 40), (1465, 1000)])
def test_coder_blocks_are_independent(monkeypatch, blocks, lanes):
    monkeypatch.setattr(token_coder, "LANES", lanes)
    monkeypatch.setattr(token_coder, "BLOCK", 256)
    rng = np.random.default_rng(blocks)
    ids = rng.zipf(1.3, 256 * blocks - 7) % 49408
    data = token_coder.encode(ids)
    assert (token_coder.decode(data) == ids).all()
    changed = np.concatenate([ids[256:], ids[:256]]) if blocks > 1 else ids
    assert (token_coder.decode(token_coder.encode(changed)) == changed).all()
    assert len(data) < 2 * len(ids) + 12 * blocks + 200_000


def test_coder_gains_by_context(monkeypatch):
    """A sequence that orders 1 and 2 predict takes far less than one of the same ids in no order."""
    monkeypatch.setattr(token_coder, "LEAST_BLOCK", 2048)
    rng = np.random.default_rng(3)
    ids = np.tile(rng.permutation(60), 1000)
    assert 3 * len(token_coder.encode(ids)) < len(token_coder.encode(rng.permutation(ids)))


def test_coder_detects_damage():
    data = bytearray(token_coder.encode(np.arange(6000) % 300))
    data[-200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_coder.decode(bytes(data))
    with pytest.raises(ValueError):
        token_coder.decode(b"nothing of ours.")


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "ROW_IDS", 300)
    docs = table(spark, SF, "documents").limit(60).repartition(4)
    token_files.write(docs, str(tmp_path / "x"))
    got = sorted(token_files.digest(token_files.table(spark, str(tmp_path / "x"))).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    ids = encoder(tokenizer_path()).encode([r.text for r in rows], 2)
    starts = np.cumsum([0] + [len(x) // 4 for x in ids])
    assert [tuple(r) for r in got] == [(r.doc_id, int(s), len(x) // 4, zlib.crc32(x)) for r, s, x in zip(rows, starts, ids)]
    token_files.write(odd(spark), str(tmp_path / "y"))
    assert token_files.digest(token_files.table(spark, str(tmp_path / "y"))).count() == 12


# --- 1 search -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shape", ["normal", "ties", "large"])
def test_maxscore(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(0, {"normal": 0.1, "ties": 0.004, "large": 1e6}[shape], (300, 12))
    x[200:] = x[200] if shape == "ties" else x[200:]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(900, None, 1), (950, [1.0, None], 1), (1000, [float("nan")] * 12, 1), (None, [0.5] * 12, 1), (7, [float(c) for c in x[7]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, maxscore.top_k(df, shard_rows=64, block_queries=4).collect()))
    v = np.vectorize(int, otypes=[object])(np.floor(256 * x))
    want = []
    for q in range(0, 300, 50):
        best = sorted(((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want
    assert maxscore.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["normal", "ties", "large", "huge", "falling", "constant"])
@pytest.mark.parametrize("width", [5, 64, 100])
def test_maxscore_splits_terms(shape, width):
    """More dimensions than a step, ties and values beyond exact floats: as brute force, and both kinds of steps occur."""
    rng = np.random.default_rng(width)
    x = rng.normal(0, 1, (400, width))
    if shape == "falling":
        x *= 0.7 ** np.arange(width)
    if shape == "ties":
        x = np.sign(x) * (rng.random((400, width)) < 0.2)
        x[300:] = x[300]
    x = np.floor(x * {"large": 1e5, "huge": 1e9}.get(shape, 256.0)) if shape != "constant" else np.full((400, width), 3.0)
    ids, steps = rng.permutation(400).astype(np.int64), Counter()
    got = maxscore.search(ids[:20], x[:20], ids, x, 5, steps)
    v = np.vectorize(int, otypes=[object])(x)
    want = []
    for q in range(20):
        best = sorted((-int(s), int(i)) for s, i in zip(v @ v[q], ids) if i != ids[q])[:5]
        want += [(int(ids[q]), i, -s) for s, i in best]
    assert [(a, b, c) for a, b, c in got] == want
    if width > maxscore.STEP:
        assert sum(steps.values()) > 0 and (shape != "falling" or steps["probed"])


# --- 3, 4, 7 classifiers ------------------------------------------------------------------------------------------

def test_automaton_accepts_substrings():
    s = [random.Random(5).randrange(3) for _ in range(60)]
    to = langid.suffix_automaton(s, 3)
    grams = {tuple(s[i:j]) for i in range(60) for j in range(i, min(i + 6, 60))}
    for k in range(3**5):
        word = [k // 3**j % 3 for j in range(5)]
        state = 0
        for c in word:
            state = to[state, c] if state >= 0 else -1
        assert (state >= 0) == (tuple(word) in grams)


def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in rows) == len(held)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    und = {r.doc_id for r in langid.identified(odd(spark)).collect() if r.lang_pred == "und"}
    assert {0, 1, 2, 9} <= und
    assert langid.identified(odd(spark).limit(0)).count() == 0


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_phrases_are_the_longest():
    p = langid.Parser([("a", "abracadabra"), ("b", "barbara bar")])
    e = p.entropies(["abracabar"])[0]
    sample = "abracadabra "
    assert round(e[0] * 9 / p.bits[0]) == brute_phrases("abracabar", sample)


def brute_language(texts, sample, letters):
    """langid's definition by substring search: a character a symbol, a space a run of separators."""
    counts = collections.Counter(c for _, t in sample for c in t.lower() if c.isalpha())
    own = set(sorted(counts, key=lambda c: (-counts[c], c))[:letters])

    def symbols(text):
        out = "".join(c if c in own else f"{ord(c):06x}".translate({ord(d): 0xE000 + int(d, 16) for d in "0123456789abcdef"}) if c.isalpha() else " " for c in (text or "").lower())
        return " ".join(out.split())

    known = {lang: "".join(symbols(t) + " " for x, t in sample if x == lang) for lang, _ in sample}
    for text in texts:
        x = symbols(text)
        if not x:
            yield "und", 0.0
            continue
        windows = [x[i : i + langid.WINDOW] for i in range(0, len(x), langid.WINDOW)]
        needed = sorted((sum(brute_phrases(w, known[lang]) for w in windows) * np.log2(len(known[lang])) / len(x), lang) for lang in known)
        yield needed[0][1], needed[1][0] / (needed[0][0] + needed[1][0])


@pytest.mark.parametrize("letters", [langid.LETTERS, 12])
def test_languages_equal_brute_force(spark, monkeypatch, letters):
    """Whole texts of several windows, letters that a language never has, letters written in digits, texts that tie."""
    monkeypatch.setattr(langid, "LETTERS", letters)
    monkeypatch.setattr(langid, "_built", {})
    rows = table(spark, "/root/testdata/sf0.001", "documents").where("lang is not null and length(text) between 20 and 3000").orderBy("doc_id").limit(60).collect()
    sample = [(r.lang, r.text) for r in rows[:24]] + [("zz", "жжж зз"), ("aa", "same"), ("bb", "same")]
    texts = [r.text for r in rows[24:]] + ["", None, "12 ...", "same", "жаж", "ж", "aжaжa", "日本 語x", "x" * 600 + "é" * 300]
    got_lang, got = langid.Parser(sample).predict(texts)
    want = list(brute_language(texts, sample, letters))
    assert got_lang == [w[0] for w in want] and got == pytest.approx([w[1] for w in want], rel=1e-12)
    assert got_lang[texts.index("same")] == "aa" and max(map(len, texts[:36])) > langid.WINDOW


def test_quality_equals_brute_force(spark):
    """The score of each document by the definition, with a compressor of its own for every block."""
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    m = quality.fit(docs, labels, F.lit(True))
    size = lambda block, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))
    for r in quality.with_score(docs.limit(80), m).collect():
        raw = (r.text or "").encode()
        parts = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        good, bad = (sum(size(p, d) for p in parts) for d in (m.good, m.bad))
        x = [(bad - good) / (bad + good), np.log(good / len(raw)), np.log(good / len(raw)) ** 2] if raw else [0.0] * 3
        z = sum((v - mean) / scale * w for v, mean, scale, w in zip(x, m.mean, m.scale, m.weights)) + m.weights[3]
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_labels_are_predicted(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    rows = module.scores(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) > least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    edge = module.scores(odd(spark), labels.limit(0))
    assert edge.count() == 12
    known = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (6, 1, 1), (8, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert module.scores(odd(spark), known).where("score is null or score < 0 or score > 1").count() == 0


class BruteKneserNey:
    """The same by the definition, over sets and counters."""

    def __init__(self, words):
        self.k = {5: {c: Counter() for c in (0, 1)}}
        for w, toxic, plain in words:
            w = "\x01" * 4 + w + "\x02"
            for i in range(len(w) - 4):
                self.k[5][1][w[i : i + 5]] += toxic
                self.k[5][0][w[i : i + 5]] += plain
        kinds = {c: {g for g, n in self.k[5][c].items() if n} for c in (0, 1)}
        for n in (4, 3):
            self.k[n] = {c: Counter(g[1:] for g in kinds[c]) for c in (0, 1)}
            kinds = {c: set(self.k[n][c]) for c in (0, 1)}
        both = kinds[0] | kinds[1]
        for n in (2, 1):
            count = Counter(g[1:] for g in both)
            self.k[n], both = {0: count, 1: count}, set(count)

    def p(self, gram, c):
        n, count = len(gram), self.k[len(gram)][c]
        if n == 1:
            total, kinds = sum(count.values()), len(count)
            return max(count[gram] - 0.75, 0) / total + 0.75 * kinds / total / (kinds + 1)
        after = [v for g, v in count.items() if g[:-1] == gram[:-1] and v]
        if not after:
            return self.p(gram[1:], c)
        return max(count[gram] - 0.75, 0) / sum(after) + 0.75 * len(after) / sum(after) * self.p(gram[1:], c)


def test_kneser_ney(spark):
    """Probabilities are those of the definition, and sum to one over all letters, the end and one that was never seen."""
    rnd = random.Random(9)
    words = [("".join(rnd.choice("abcdé日") for _ in range(rnd.randint(1, 6))), rnd.randint(0, 3), rnd.randint(0, 3)) for _ in range(60)]
    words = list({w: (w, t, p) for w, t, p in words if t + p}.values())
    counts = toxicity.gram_counts(spark.createDataFrame(words, "word string, toxic long, plain long"))
    heads = {("\x01" * 4 + w)[i : i + 4] for w, _, _ in words for i in range(len(w) + 1)} | {"zzzz", "\x01\x01za"}
    letters = sorted({x for w, _, _ in words for x in w}) + ["\x02", "z"]
    grams = [h + x for h in sorted(heads) for x in letters]
    got = {r.gram: (r.plain, r.toxic) for r in toxicity.probabilities(spark.createDataFrame([(g,) for g in grams], "gram string"), counts).collect()}
    brute = BruteKneserNey(words)
    assert len(got) == len(grams)
    for g in grams:
        assert got[g] == (pytest.approx(brute.p(g, 0)), pytest.approx(brute.p(g, 1)))
    for h in heads:
        for c in (0, 1):
            assert sum(got[h + x][c] for x in letters) == pytest.approx(1)


def test_toxicity_with_many_grams(spark, monkeypatch):
    """Joins instead of a broadcast give the same scores, with frequent words dealt to several tasks too."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents").unionByName(odd(spark).select(*docs_of(spark, []).columns)), table(spark, "/root/testdata/sf0.01", "labels")
    few = {r.doc_id: r.score for r in toxicity.scores(docs, labels).where("doc_id >= 10").collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(toxicity, "COMMON", 20)
    rows = toxicity.scores(docs, labels)
    assert rows.count() == docs.count()
    assert {r.doc_id: r.score for r in rows.where("doc_id >= 10").collect()} == {k: pytest.approx(v, abs=1e-4) for k, v in few.items()}


# --- 5 pages ------------------------------------------------------------------------------------------------------

def page(body, side="Same <b>on</b> all"):
    return f"<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><header>Site</header>{body}<aside>{side}</aside><div class='comments'><p>nice!</div><form>Mail <input></form><footer>&copy; x</footer></body></html>"  # noqa: E501


def test_html(spark):
    rows = [(i, "http://h.example/a", page(f"<article><h1>Title {i}</h1><p>One &amp;\n two<p>Three<!-- no --></article>")) for i in range(4)]
    rows += [(10 + i, "http://n.example/", page(f"<div id=top><p>Banner text</div><div class=story><p>Story {i} begins</p><p>and ends {i}</p></div>")) for i in range(4)]
    rows += [(20, None, None), (21, "no url", ""), (22, "http://h.example", "plain &lt;text&gt;"), (23, "http://h.example", "<p>cut off <b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in html_wrappers.extracted(df).collect()}
    for i in range(4):
        assert got[i] == (f"Title {i} One & two Three", 23)
        assert got[10 + i][0] == f"Story {i} begins and ends {i}"
    assert got[20] == got[21] == ("", 0) and got[22][0] == "plain <text>" and got[23][0] == "cut off"
    assert html_wrappers.extracted(df.limit(0)).count() == 0


def shape(body):
    return html_wrappers.folded([t.path for t in html_wrappers.blocks(f"<body>{body}</body>")])


def test_wrappers_align():
    w = None
    for body in ("<p>a</p><div class=x>k</div>", "<p>b</p><p>c</p><div class=x>k</div>", "<div class=x>k</div>"):
        w = shape(body) if w is None else html_wrappers.align(w, shape(body))
    assert [(i.optional, i.repeated) for i in w] == [(True, True), (False, False)]


def test_groups_of_several_blocks_repeat():
    pair = "<h2>t</h2><p>a</p><p>b</p>"
    once, often = shape(f"<h1>x</h1>{pair}<div>end</div>"), shape(f"<h1>x</h1>{pair * 5}<div>end</div>")
    assert [(len(i.paths), i.repeated) for i in often] == [(1, False), (2, True), (1, False)]
    for w in (html_wrappers.align(once, often), html_wrappers.align(often, once)):
        assert [(len(i.paths), i.repeated, i.optional) for i in w] == [(1, False, False), (2, True, False), (1, False, False)]


def test_long_shapes_align(monkeypatch):
    """Stretches too long to compare item by item are aligned by the items that occur once."""
    a = [html_wrappers.Item((i,), False) for i in range(3000)]
    b = [html_wrappers.Item((i if i % 7 else -i - 1,), False) for i in range(3000)]
    w = html_wrappers.align(a, b)
    assert [x.paths[0] for x in w if not x.optional] == [i for i in range(3000) if i % 7]
    assert sum(x.optional for x in w) == 2 * len(range(0, 3000, 7))


def test_wrappers_decide(spark):
    """Pages without article, main or telling names: menus, teasers and notices go by what the host's pages share."""
    rnd = random.Random(13)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        story = [words(3), *(words(40) for _ in range(rnd.randint(1, 4)))]
        notice = "<p>We sell a thing that nobody needs, call us today.</p>" if i % 4 else ""
        teasers = "".join(f"<li><a href=x>{words(4)}</a>" for _ in range(rnd.randint(2, 6)))
        body = f"<div class=a1><ul><li>Start<li>All of it<li>Old things</ul></div><div class=b{i}><h1>{story[0]}</h1>{''.join(f'<p>{t}</p>' for t in story[1:2])}{notice}{''.join(f'<p>{t}</p>' for t in story[2:])}<div class='social-history promo-text'><p>{words(6)}</p></div></div><div class=c1><ul>{teasers}</ul></div><div class=d1>Made by us</div>"  # noqa: E501
        rows.append((i, f"http://w.example/{i}", f"<html><body>{body}</body></html>"))
        want[i] = [*story, body.split("promo-text'><p>")[1].split("</p>")[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 5):
        got = {r.page_id: r for r in html_wrappers.extracted(df.repartition(parts)).collect()}
        assert all(got[i].by_wrapper and got[i].text == " ".join(want[i]) for i in want)


@pytest.mark.parametrize("page", ['<button a="x">' * 40_000, "<div>" * 20_000 + "x</section>" * 20_000, "<h2>a</h2><p>b</p>" * 20_000, '<a b="' * 40_001, "<svg>" * 30_000, "<!--" * 30_000, "<" * 100_000, "<div><p>x" * 20_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_wrappers.folded([t.path for t in html_wrappers.blocks(page)])
    html_wrappers.main_text(page, (1, True, frozenset()))
    assert time.process_time() - began < 10


def plain_page(i: int, paragraphs: list[str]) -> str:
    """A page without telling elements or names: menu, advert, text and footer are divs."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<body><div><ul><li><a href='/{i}'>menu {i}</a></li></ul></div><div>advert {i}</div><div><h1>Title {i}</h1>{body}<ul><li>point {i}</li></ul></div><div>&copy; {i}</div></body>"


def test_html_that_varies_beside_prose_goes(spark):
    """Also on a page whose prose is short, and on a host with one page; a page without prose keeps what it has."""
    long = "many words of prose that are longer than what is around them"
    rows = [(i, f"http://plain.example/{i}", plain_page(i, [f"{long} {i}", f"more {i}"])) for i in range(5)]
    rows += [(5, "http://plain.example/5", plain_page(5, ["x"])), (6, "http://one.example/6", plain_page(6, [long])), (7, "http://plain.example/7", "<body><div>only 7</div></body>"), (8, "http://none.example/8", "<body><div>a note</div><div>much longer text in a division</div></body>")]
    got = {r.page_id: r.text for r in html_wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"Title {i} {long} {i} more {i} point {i}" for i in range(5))
    assert (got[5], got[6], got[7], got[8]) == ("Title 5 x point 5", f"Title 6 {long} point 6", "only 7", "a note much longer text in a division")
    for i in range(5):  # null pages, ids and urls
        rows[i] = (None, None, rows[i][2])
    assert sorted(r.text for r in html_wrappers.extracted(spark.createDataFrame([*rows[:5], (None, None, None)], "page_id long, url string, html string")).collect())[1:] == sorted(got[i] for i in range(5))


def test_html_inside_articles_stays(spark):
    rows = [(i, "http://h.example/a", page(f"<article><h1>T {i}</h1><div class='social-history'><p>Kept {i}</p></div><p class='promo-text'>Also {i}</p><div class='ad-box'>Buy {i}</div></article>")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for d in (df, df.limit(1)):
        assert all(r.text == f"T {r.page_id} Kept {r.page_id} Also {r.page_id}" for r in html_wrappers.extracted(d).collect())


# --- 6 lines ------------------------------------------------------------------------------------------------------

def test_recurring_lines_go(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(8))
    own = [[line(), line()] for _ in range(30)]
    texts = [f"{a}\nPage {i} of 40, all rights reserved.\n\n{b}" for i, (a, b) in enumerate(own)]
    texts += ["\n".join(["copied first line of all", "copied second line", "copied third line"])] * 40
    texts += [f"{line()}\nposted on monday by {word()} in the town hall\n{line()}" for _ in range(30)]
    df = docs_of(spark, texts).unionByName(odd(spark).select(*docs_of(spark, []).columns).withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r.doc_id: r for r in line_dedup.line_counts(df).collect() if r.doc_id is not None}
    for i, (a, b) in enumerate(own):
        assert got[i].text == f"{a}\n\n{b}" and (got[i].n_lines, got[i].n_dropped) == (3, 1)
    assert all(got[i].n_dropped == 0 for i in range(30, 70))  # copies are near-dedup's business
    assert all(got[i].n_dropped == 1 and "posted on" not in got[i].text for i in range(70, 100))
    assert got[1000].text is None and got[1001].text == "" and got[1005].text == ODD[5]
    cleaned = line_dedup.cleaned(odd(spark))
    assert cleaned.columns == odd(spark).columns and cleaned.count() == 12
    assert line_dedup.cleaned(odd(spark).limit(0)).count() == 0
    assert "Python" not in cleaned._jdf.queryExecution().toString() and "Arrow" not in cleaned._jdf.queryExecution().toString()


def test_runs_of_recurring_lines_go(spark):
    rnd = random.Random(8)
    line = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    menu = ["home and all the news", "sports on every day", "weather for the coast", "contact our small office"]
    own = [line() for _ in range(12)]
    texts = ["\n".join([*menu, x, "our footer begins here", "and our footer ends there"]) for x in own]
    note = "a note that one carrier repeats"
    apart = [[line(), line()] for _ in range(12)]
    texts += [f"{a}\n{note}\n{b}" for a, b in apart]
    texts += [f"copied above the note\n{note}\ncopied below the note"] * 1000
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(12)] == own
    assert [got[i] for i in range(12, 24)] == [f"{a}\n{b}" for a, b in apart]
    assert all(got[i] == "copied above the note\ncopied below the note" for i in range(24, 1024))


def test_several_templates_of_a_leaf(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(8))
    ways = ["seen in the garden of {} near our old mill", "seen in the street by {} before his long walk", "seen in the office with {} after their short call"]
    texts = [f"{line()}\n{way.format(word())}\n{line()}" for way in ways for _ in range(30)]
    rows = docs_of(spark, texts)
    assert sum(r.n_dropped for r in line_dedup.line_counts(rows).collect()) == 90
    clashing = rows.withColumns({"ats": F.lit(1), "_at": F.lit("user's"), "_doc": F.lit(2), "_ats": F.lit(3), "DOC": F.lit(4)})
    got = line_dedup.cleaned(clashing)
    assert got.columns == clashing.columns
    assert all(r.text.count("\n") == 1 and (r["ats"], r["_at"], r["_doc"], r["_ats"], r["DOC"]) == (1, "user's", 2, 3, 4) for r in got.collect())


# --- 9 decontamination --------------------------------------------------------------------------------------------

def test_lcs():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_leaks_are_found(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [text(rnd.randint(15, 50)) for _ in range(12)] + [None, ""]
    docs, want = [], set()
    for i in range(80):
        body = text(rnd.randint(0, 300))
        if i % 4 == 0:
            item = i // 4 % 12
            leak = items[item].split()
            if i % 8 == 0:  # a paraphrase: every fifth word is another
                leak = [rnd.choice(words) if k % 5 == 2 else w for k, w in enumerate(leak)]
            body = f"{text(rnd.randint(0, 60))} {' '.join(leak).upper()}. {body}"
            want.add((i, item))
        elif i % 4 == 1:  # a few words in common are no leak
            body += " " + " ".join(items[i % 12].split()[:5])
        docs.append(body)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs_of(spark, docs).repartition(3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
    kept = decontaminate.clean(df.withColumn("score", F.lit(1)), bench)
    assert kept.columns == [*df.columns, "score"] and {r.doc_id for r in kept.collect()} == set(range(80)) - {d for d, _ in want}
    assert decontaminate.clean(odd(spark), bench).count() == 12 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.leaks(df.limit(0), bench).count() == 0


def test_long_items_are_found_by_their_parts(spark, monkeypatch):
    """Whole copies, and paraphrases of every fifth word, of items whose passages are too small a part to be near them."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [text(n) for n in (300, 700, 160, 20)]
    docs, want = [text(250) for _ in range(60)], set()
    for i in range(0, 40, 5):
        item = i // 5 % 4
        leak = items[item].split()
        if i >= 20:
            leak = [rnd.choice(words) if k % 5 == 2 else w for k, w in enumerate(leak)]
        docs[i] = f"{text(rnd.randint(0, 90))} {' '.join(leak)}. {docs[i]}"
        want.add((i, item))
    docs[3] += " " + " ".join(items[1].split()[100:200])  # a seventh of an item is no leak of it
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs_of(spark, docs).repartition(3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 12)
    assert [b.ids for b in decontaminate.blocks(bench)] == [[0, 1], [2, 3]]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want


def test_leaks_hold_all_of_high_shingle_overlap(spark):
    """Brute force: whoever holds four fifths of an item's five-word shingles is among the leaks."""
    from tidewake.llm.queries import QUERIES

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [decontaminate.words_of(t)] for i in range(len(w) - 4)}
    items = {r.item_id: x for r in table(spark, SF, "benchmark").collect() if (x := shingles(r.text))}
    docs = {r.doc_id: shingles(r.text) for r in table(spark, SF, "documents").collect()}
    want = {(d, i) for d, x in docs.items() for i, y in items.items() if len(x & y) >= 0.8 * len(y)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    assert want and want <= got


def test_registered_digests_are_those_of_the_library(spark):
    """op2 and op8 as registered against the tokenizers library, op10 against brute force, on a whole small table."""
    from tidewake.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    tok = encoder(tokenizer_path()).tokenizer
    ids = {d: tok.encode(t, add_special_tokens=False).ids for d, t in docs}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    coded, start = [], 0
    for d, _ in docs:
        coded.append((d, start, len(ids[d]) + 1, crc([*ids[d], 2])))
        start += len(ids[d]) + 1
    assert sorted(tuple(r) for r in QUERIES["op8_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == coded
    pieces = QUERIES["op2_packing"](spark, SF).collect()
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) + 1 and p.ids_crc32 == crc([*ids[p.doc_id], 1][p.start : p.start + p.length])
    assert sum(p.length for p in pieces) == start and all(p.length > 0 for p in pieces)
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    want = sorted((d, f"{fp:016x}", c) for (d, fp), c in zip(fps, brute_classes(fps)))
    assert sorted(tuple(r) for r in QUERIES["op10_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()) == want


# --- pipeline -----------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == table(spark, SF, "documents").columns
    left = docs.collect()
    e = encoder(tokenizer_path())
    want = sorted((r.doc_id, len(x) // 4) for r, x in zip(left, e.encode([r.text for r in left], 1)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted({(r.doc_id, r.doc_tokens) for r in got}) == want
    assert sum(r.length for r in got) == sum(n for _, n in want)
    odd_rows = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_rows, SF).count() > 0 and stage(spark, odd_rows.limit(0), SF).count() == 0


def test_oracles(spark):
    import duckdb

    from tidewake.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF)
        want = con.sql(sql)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr) and got.columns == want.columns
