"""SimHash near-duplicates by anchor-point covering.

Fingerprint: words are the runs of bytes other than space and 09-0D of the text with A-Z lower-cased; each shingle of
three words (with fewer words, the whole sequence) is hashed with XXH64, seed 42; a bit is 1 if it is set in more than
half of the hashes.  No words, or a null text: fingerprint zero.

Linking: the anchors are the 2^26 words of the Hamming code over the low 31 bits, whose covering radius is 1.  A link
spans at most THRESHOLD = 2 bits, so a midpoint lies within 1 of both ends and its anchor within 1 + 1 of both.  Every
distinct fingerprint therefore goes to each anchor within 2 (1 or 16 of them), which finds all the pairs that the wider
ball of radius + threshold = 3 (156 anchors a fingerprint) would find.  Per anchor the fingerprints are compared in
full, and a spanning set of links leaves, not all pairs.  An anchor with more than ANCHOR_LIMIT fingerprints is not
compared: its members go to the finer covering by all 64-bit words (radius 0), within 1 of which lie at most 65
fingerprints, all of one component; so the work per anchor has a bound and no link is lost.

All that is op10_simhash.  The pipeline's stage (``deduplicated``) links texts whose sets of five-word shingles have a
Jaccard similarity of at least 0.8.  The same covering only finds its candidates, over BLOCKS fingerprints of 31 bits; a
candidate is a pair within 2 bits in any block, and is then compared exactly (by 64-bit hashes of the shingles).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, shared_dir, small, stored, tidy

SEED = 42
SHINGLE = 3
THRESHOLD = 2
CODE_BITS = 31
ANCHOR_LIMIT = 512

NEAR_SHINGLE = 5  # the stage's: words, and the least Jaccard similarity, as a fraction
NEAR_SIMILARITY = (4, 5)
BLOCKS = 12  # two in each 64-bit word of the stage's fingerprint
BLOCK_SHINGLE = 2
NEAR_BITS = 20  # candidates differ in no more bits of another word of the fingerprint


def text_fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(stops), 1 << 16):  # bounded memory for very long texts
        part = stops[at : at + (1 << 16)]
        h = np.array([digest(view[a:b], SEED) for a, b in zip(starts[at : at + len(part)], part)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Xor of the positions 1..31 of the bits that are set: zero for the code's words."""
    s = np.zeros(len(x), np.int64)
    for i in range(CODE_BITS):
        s ^= ((x >> i) & 1) * (i + 1)
    return s


def _ball() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the masks of at most two bits with it, and how many there are."""
    masks = np.zeros((CODE_BITS + 1, 16), np.int64)
    count = np.zeros(CODE_BITS + 1, np.int64)
    for i in range(CODE_BITS + 1):
        for j in range(i + 1, CODE_BITS + 1):  # position 0: no second bit
            s = i ^ j
            masks[s, count[s]] = (1 << (j - 1)) | ((1 << (i - 1)) if i else 0)
            count[s] += 1
    count[0] = 1  # only the word itself: two different positions never give zero
    return masks, count


def anchors(fps: DataFrame) -> DataFrame:
    """(anchor, fp) for each anchor within 2 bits of fp's low 31 bits."""
    masks, count = _ball()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 4096):
            fp = t.column("fp").to_numpy()
            low = fp & ((1 << CODE_BITS) - 1)
            s = _syndromes(low)
            use = np.arange(16) < count[s][:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array((low[:, None] ^ masks[s])[use]), pa.array(np.repeat(fp, count[s]))], names=["anchor", "fp"]
            )

    return fps.select("fp").mapInArrow(tidy(run), "anchor long, fp long")


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) of the graph with edges a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _compare(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs of at most THRESHOLD bits between rows of one anchor; rows come ordered by anchor."""
    left, right = [], []
    for lag in range(1, len(fp)):
        same = np.flatnonzero(anchor[lag:] == anchor[:-lag])
        if not len(same):
            break
        near = same[np.bitwise_count((fp[same] ^ fp[same + lag]).view(np.uint64)) <= THRESHOLD]
        left.append(fp[near])
        right.append(fp[near + lag])
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    keep = a != b
    return _spanning(a[keep], b[keep])


def _per_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by anchor to links (u, v); (u, null) for the members of an anchor above ANCHOR_LIMIT."""

    def out(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(u), pa.array(v) if v is not None else pa.nulls(len(u), pa.int64())], names=["u", "v"]
        )

    held_a, held_f, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
    for t in grouped(batches, 16384):
        a = np.concatenate([held_a, t.column(0).to_numpy()])
        f = np.concatenate([held_f, t.column(1).to_numpy()])
        if hot is not None:  # the rest of an anchor that was already too large
            n = int(np.searchsorted(a, hot, "right"))
            if n:
                yield out(f[:n], None)
                a, f = a[n:], f[n:]
            if not len(a):
                held_a, held_f = a, f
                continue
            hot = None
        cut = int(np.searchsorted(a, a[-1]))
        if len(a) - cut > ANCHOR_LIMIT:
            hot, cut = int(a[-1]), len(a)
        held_a, held_f, a, f = a[cut:], f[cut:], a[:cut], f[:cut]
        yield from _complete(a, f, out)
    yield from _complete(held_a, held_f, out)


def _complete(a: np.ndarray, f: np.ndarray, out) -> Iterator[pa.RecordBatch]:
    if not len(a):
        return
    _, inverse, size = np.unique(a, return_inverse=True, return_counts=True)
    large = size[inverse] > ANCHOR_LIMIT
    if large.any():
        yield out(np.unique(f[large]), None)
    yield out(*_compare(a[~large], f[~large]))


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, fp) for the 65 64-bit words within 1 of fp."""
    flips = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))]).astype(np.uint64).view(np.int64)
    for t in grouped(batches, 1024):
        fp = t.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array((fp[:, None] ^ flips).ravel()), pa.array(np.repeat(fp, 65))], names=["word", "fp"]
        )


def links(fps: DataFrame) -> DataFrame:
    """Distinct (u, v), u != v, that connect the fingerprints (column fp, distinct) exactly as their close pairs do."""
    dealt = anchors(fps).repartition("anchor").sortWithinPartitions("anchor")
    found = stored(dealt.mapInArrow(tidy(_per_anchor), "u long, v long").distinct(), "simhash-links")
    fine = (
        found.where("v is null").select("u").mapInArrow(tidy(_fine), "word long, fp long")
        .groupBy("word").agg(F.collect_set("fp").alias("fps"))  # at most 65
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u != v")
    )
    return found.where("v is not null").select("u", "v").unionByName(fine.select("u", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): alternating large and small stars, until nothing changes.

    Each round links a node's neighbours to the smallest of them, so that no node's neighbours meet in one task: the
    minimum is a partial aggregate and goes back by an equi-join, which adaptive execution can split.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u != v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = small.where("u != v").distinct().checkpoint()
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included), a row per input row.

    Null texts have fingerprint zero and are linked like any other; repeated rows stay repeated; rows of a null doc_id
    take part, and their component_id is null only where no linked row has an id.
    """
    fp = stored(fingerprints(docs), "simhash-fp")
    own = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(own.select("fp")))
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finish of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key_and_words(text: str | None) -> tuple[int, np.ndarray]:
    """A hash of the sequence of words, and a hash of each word; words are the same as text_fingerprint's."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return digest(b" ".join(words), SEED), np.array([digest(w, SEED) for w in words], np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of runs of so many words; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = _mixed(h * _GOLDEN + words[i : n + i] + np.uint64(i + 1))
    return np.unique(h)


def _block_words(words: np.ndarray) -> list[int]:
    """The stage's fingerprint as BLOCKS / 2 signed numbers; empty without words."""
    shingles, out = _shingles(words, BLOCK_SHINGLE), []
    for k in range(BLOCKS // 2 if len(words) else 0):
        ones, salt = np.zeros(64, np.int64), np.full(1, k + 1, np.uint64) * _GOLDEN
        for at in range(0, len(shingles), 1 << 16):
            h = _mixed(shingles[at : at + (1 << 16)] + salt)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(shingles)).view(np.int64)[0]))
    return out


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (equal for equal words) and fps (the words of the stage's fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_key_and_words(t) for t in b.column(1).to_pylist()]
            key = pa.array(np.array([k for k, _ in found], np.uint64).view(np.int64))
            fps = pa.array([_block_words(w) for _, w in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), key, fps], names=["doc_id", "key", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, key long, fps array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key and grams (the hashes of its distinct five-word shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_key_and_words(t) for t in b.column(0).to_pylist()]
            key = pa.array(np.array([k for k, _ in found], np.uint64).view(np.int64))
            grams = pa.array([_shingles(w, NEAR_SHINGLE).view(np.int64) for _, w in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([key, grams], names=["key", "grams"])

    return docs.select("text").mapInArrow(tidy(run), "key long, grams array<long>")


def block_anchors(own: DataFrame) -> DataFrame:
    """(anchor, key, fp) for each anchor within 2 bits of each block; fp is the fingerprint's word after the block's."""
    masks, count = _ball()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 4096):
            t = t.combine_chunks()
            key = t.column("key").to_numpy()
            fps = t.column("fps").combine_chunks().flatten().to_numpy().reshape(len(key), BLOCKS // 2)
            for block in range(BLOCKS):
                low = (fps[:, block // 2] >> (32 * (block % 2))) & ((1 << CODE_BITS) - 1)
                s = _syndromes(low)
                use, n = np.arange(16) < count[s][:, None], count[s]
                anchor = (low[:, None] ^ masks[s])[use] | (block << CODE_BITS)
                fp = fps[:, (block // 2 + 1) % (BLOCKS // 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(np.repeat(key, n)), pa.array(np.repeat(fp, n))], names=["anchor", "key", "fp"]
                )

    return own.select("key", "fps").mapInArrow(tidy(run), "anchor long, key long, fp long")


GROUPS = "anchor long, rep long, key long, fp long, near boolean"


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by anchor to GROUPS: each anchor's first member (rep) with every other, and whether they are near.

    Members that are near no other of their anchor are left out, except in an anchor above ANCHOR_LIMIT.
    """

    def out(a: np.ndarray, rep: np.ndarray, rep_fp: np.ndarray, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cols = [a, rep, k, f, _differ(f, rep_fp) <= NEAR_BITS]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "rep", "key", "fp", "near"])

    def complete(a: np.ndarray, k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(a):
            return
        _, inverse, size = np.unique(a, return_inverse=True, return_counts=True)
        member = size[inverse] > ANCHOR_LIMIT
        few = np.flatnonzero(~member)
        for lag in range(1, len(few)):
            same = np.flatnonzero(a[few[lag:]] == a[few[:-lag]])
            if not len(same):
                break
            i, j = few[same], few[same + lag]
            near = _differ(f[i], f[j]) <= NEAR_BITS
            member[i[near]] = member[j[near]] = True
        a, k, f = a[member], k[member], f[member]
        if len(a):
            _, first, inverse = np.unique(a, return_index=True, return_inverse=True)
            at = first[inverse]
            rest = at != np.arange(len(a))
            yield out(a[rest], k[at][rest], f[at][rest], k[rest], f[rest])

    held, hot = [np.empty(0, np.int64)] * 3, None
    for t in grouped(batches, 16384):
        rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, t.columns)]
        if hot is not None:  # the rest of an anchor that was already too large
            n = int(np.searchsorted(rows[0], hot[0], "right"))
            if n:
                a, k, f = (x[:n] for x in rows)
                yield out(a, np.full(n, hot[1]), np.full(n, hot[2]), k, f)
                rows = [x[n:] for x in rows]
            if not len(rows[0]):
                held = rows
                continue
            hot = None
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if len(rows[0]) - cut > ANCHOR_LIMIT:
            hot, cut = [x[cut] for x in rows], len(rows[0])
        held = [x[cut:] for x in rows]
        yield from complete(*(x[:cut] for x in rows))
    yield from complete(*held)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of keys whose shingle sets are similar enough."""
    part, whole = NEAR_SIMILARITY
    a, b = sets.select(F.col("key").alias("u"), F.col("grams").alias("a")), sets.select(F.col("key").alias("v"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(both * whole >= part * (F.size("a") + F.size("b") - both)).select("u", "v")


def near_links(docs: DataFrame, fp: DataFrame) -> DataFrame:
    """(node, root) of the keys that candidate search and exact comparison link; fp is near_fingerprints(docs).

    An anchor's members are first compared with its first member only.  Then those that this leaves outside its component
    are compared with all members of other components, so every candidate pair is compared or connected already.
    """
    own = fp.where(F.size("fps") > 0).groupBy("key").agg(F.first("fps").alias("fps"))
    dealt = block_anchors(own).repartition("anchor").sortWithinPartitions("anchor")
    groups = stored(dealt.mapInArrow(tidy(_groups), GROUPS), "near-groups")
    keys = small(stored(groups.select("key").union(groups.select("rep")).distinct(), "near-keys"))
    ids = small(stored(fp.join(keys, "key").groupBy("key").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "near-ids"))
    texts = docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_id"]), "left_semi")
    sets = stored(shingle_sets(texts).join(keys, "key", "left_semi").dropDuplicates(["key"]), "near-sets")
    stars = stored(_similar(groups.where("near").select(F.col("rep").alias("u"), F.col("key").alias("v")).distinct(), sets), "near-stars")
    roots = stored(components(stars), "near-roots")
    named = small(roots)
    placed = (
        groups.join(named.withColumnsRenamed({"node": "key", "root": "_k"}), "key", "left")
        .join(named.withColumnsRenamed({"node": "rep", "root": "_r"}), "rep", "left")
        .select("anchor", "key", "fp", F.coalesce("_k", "key").alias("root"), F.coalesce("_r", "rep").alias("of"))
    )
    x = placed.where("root != of").select("anchor", F.col("key").alias("x"), F.col("fp").alias("xf"), F.col("root").alias("xr"))
    close = x.join(placed, "anchor").where(F.col("root") != F.col("xr")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("xf"))) <= NEAR_BITS)
    more = stored(_similar(close.select(F.least("x", "key").alias("u"), F.greatest("x", "key").alias("v")).distinct(), sets), "near-more")
    return roots if more.isEmpty() else components(stars.unionByName(more))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and component_id as classes() has them, a row per input row, by the stage's similarity.  Texts of the same
    words are linked, so texts without words are too."""
    fp = stored(near_fingerprints(docs), "near-fp")
    own = fp.groupBy("key").agg(F.min("doc_id").alias("low"))
    rooted = own.join(near_links(docs, fp).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("key", "root").join(least, "root").select("key", "component_id")
    return fp.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id, whole; rows that repeat a doc_id are one
    document and collapse.  Rows without doc_id go if their class has a document with one, else one of them stays."""
    named = stored(near_classes(docs), "near-classes")
    keep = named.where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    keep = small(stored(keep, "near-kept"))
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept"]), "left_semi")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id"])
