"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Largest inner products become smallest angles: a vector x of the largest norm M or less gets one more component,
sqrt(M^2 - |x|^2), and a query zero there.  Codes are signs of rotated vectors; the ROTATIONS rotations are learned by iterative
quantisation on the SAMPLE vectors with the smallest hashed ids.  Every vector is coded and indexed.

Codes are cut into substrings of SUB bits, each with an inverted index by value.  A query probes the values within 0, 1, 2, ...
bits of its own substrings.  By the pigeonhole principle, with m substrings of which the first a + 1 are probed within p bits
and the others within p - 1, every code within m * p + a bits has been met, so the search is complete for its radius.  The
radius follows from the k-th inner product so far: codes of two vectors differ in a share angle / pi of the bits, and MARGIN
standard deviations more are searched.  What is met within the radius is ranked by its inner product on the original vectors.

Vectors are dealt into shards and queries into blocks of bounded size; each (shard, block) is one task of a co-grouping with
an index of its own, and the shards' winners are merged.  Equal vectors are one entry of an index, which keeps their k + 1
smallest ids: no others of them can be among a query's k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
QUERY_EVERY = 20
SAMPLE = 10_000
ROTATIONS = 2
ROUNDS = 25
SUB = 8
MARGIN = 0.6
SHARD_ROWS = 32_768
BLOCK_QUERIES = 32_768
LEAST_BLOCK = 256  # smaller inputs make blocks of so many queries, but at most MOST_BLOCKS, to have enough tasks
MOST_BLOCKS = 8
_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))
_MASKS = [np.flatnonzero(_BITS == p) for p in range(SUB + 1)]  # the values p bits from 0


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v.  Vectors that are null, zero, or hold null, NaN or infinite components, and rows without vec_id, go."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))


def matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width, as doubles; a shorter vector counts as padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def augmented(x: np.ndarray, most: float, queries: bool) -> np.ndarray:
    """One more component, by which all candidates have norm ``most``; for queries it is zero."""
    rest = np.zeros(len(x)) if queries else np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))
    return np.column_stack([x, rest])


def learned(sample: np.ndarray) -> np.ndarray:
    """(width, bits): ROTATIONS rotations, each turned until the signs of the sample's coordinates lie close to them."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    random, out = np.random.default_rng(12), []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(random.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(ROUNDS if len(x) else 0):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ v
        out.append(r)
    bits = np.hstack(out)
    return bits[:, : bits.shape[1] // SUB * SUB] if bits.shape[1] >= SUB else np.tile(bits, SUB)[:, :SUB]


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(rows, substrings) of bytes."""
    return np.packbits(x @ rotations >= 0, axis=1)


def _words(code: np.ndarray) -> list[np.ndarray]:
    """Codes as columns of 64-bit words, padded with zeros."""
    return list(np.ascontiguousarray(np.pad(code, ((0, 0), (0, -code.shape[1] % 8))).view(np.uint64).T))


def _far(words: list[np.ndarray], own: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Bits in which the codes of some rows differ from one code."""
    out = np.zeros(len(rows), np.uint16)
    for column, word in zip(words, own):
        out += np.bitwise_count(column[rows] ^ word)
    return out


class Index:
    """The inverted indexes of a shard's codes, and a search in them."""

    def __init__(self, code: np.ndarray, x: np.ndarray):
        self.x, (self.n, self.m) = x, code.shape
        self.words = _words(code)
        self.rows = np.concatenate([np.argsort(code[:, j], kind="stable") for j in range(self.m)]).astype(np.int32)
        sizes = np.concatenate([np.bincount(code[:, j], minlength=256) for j in range(self.m)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

    def met(self, query: np.ndarray, p: int, subs: int) -> np.ndarray:
        """The rows in the lists of the values exactly p bits from the query's first ``subs`` substrings; repeats included."""
        keys = ((query[:subs, None] ^ _MASKS[p]) + np.arange(subs)[:, None] * 256).ravel()
        first = self.starts[keys]
        size = self.starts[keys + 1] - first
        end = np.cumsum(size, dtype=np.int32)
        place = np.repeat(first - end + size, size)
        place += np.arange(len(place), dtype=np.int32)
        return self.rows[place]

    def search(self, query: np.ndarray, q: np.ndarray, norm: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows, their inner products with q, and the radius within which every code was met.  norm is |q| times the
        candidates' norm."""
        bits, seen, own = 8 * self.m, np.zeros(self.n, bool), _words(query[None])
        rows, scores, pending, pending_far = (np.empty(0, t) for t in (np.int64, float, np.int64, np.uint16))
        radius = bits
        for p in range(SUB + 1):
            if p * self.m > radius:
                break
            before = seen.copy()
            seen[self.met(query, p, min(self.m, radius - p * self.m + 1))] = True
            fresh = np.flatnonzero(seen ^ before)
            far = _far(self.words, own, fresh)
            pending, pending_far = np.concatenate([pending, fresh]), np.concatenate([pending_far, far])
            if len(scores) < k:  # all of it counts until there is a k-th score
                near = np.argsort(pending_far, kind="stable")[: 4 * k] if len(pending) > 4 * k else np.arange(len(pending))
                best = np.sort(self.x[pending[near]] @ q)[::-1]
                radius = self.radius(best[k - 1], norm) if len(best) >= k else bits
            use = pending_far <= radius
            rows = np.concatenate([rows, pending[use]])
            scores = np.concatenate([scores, self.x[pending[use]] @ q])
            pending, pending_far = pending[~use], pending_far[~use]
            if len(scores) >= k:
                radius = min(radius, self.radius(np.partition(scores, -k)[-k], norm))
                pending, pending_far = (x[pending_far <= radius] for x in (pending, pending_far))
        return rows, scores, radius

    def radius(self, score: float, norm: float) -> int:
        share = math.acos(max(-1.0, min(1.0, score / norm))) / math.pi
        bits = 8 * self.m
        return min(bits, math.ceil(bits * share + MARGIN * math.sqrt(bits * share * (1 - share))))


def _entries(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first row of each distinct vector, and the k + 1 smallest ids with that vector."""
    order = np.argsort(ids, kind="stable")
    raw = np.ascontiguousarray(x[order] + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    cuts = np.searchsorted(inverse[by], np.arange(len(first) + 1))
    return order[first], [ids[order[by[a : min(b, a + k + 1)]]] for a, b in zip(cuts[:-1], cuts[1:])]


def search(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rotations: np.ndarray, most: float, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of each query's k nearest found here, ties to the smaller vec_id."""
    at, members = _entries(ids, x, k)
    x = x[at]
    index = Index(codes(augmented(x, most, False), rotations), x)
    asked, found = codes(augmented(q, most, True), rotations), []
    for query_id, code, weights in zip(query_ids.tolist(), asked, q):
        rows, scores, _ = index.search(code, weights, float(np.linalg.norm(weights)) * most, k + 1)
        if len(scores) > k + 1:
            keep = scores >= np.partition(scores, -k - 1)[-k - 1]
            rows = rows[keep]
        exact = (x[rows] * weights).sum(1)  # row by row, so that equal vectors have equal scores in all shards
        best = sorted((-s, v, r) for r, s in zip(rows.tolist(), exact.tolist()) for v in members[r].tolist() if v != query_id)[:k]
        found += [(query_id, v, -s) for s, v, _ in best]
    return found


def _ids_once(x: pd.DataFrame) -> pd.DataFrame:
    if x.vec_id.is_unique:
        return x
    return x.assign(key=[tuple(v) for v in x.v]).sort_values(["vec_id", "key"]).drop_duplicates("vec_id")


def nearest(vectors: DataFrame, is_query: Column | None = None, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products that are found for each query, in double precision, ties to
    the smaller vec_id.

    Queries are the rows for which is_query holds (by default vec_id divisible by QUERY_EVERY); candidates all rows of another
    vec_id.  Rows that repeat a vec_id count once, as the one with the smallest vector.  No vectors, no rows; columns beside
    vec_id and embedding play no part."""
    rows = usable(vectors)
    is_query = F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c))
    n, queries, width, most = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v")), F.max(norm)).first()
    sample = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()]  # SAMPLE vectors at most
    rotations = learned(augmented(matrix(sample, width or 1), most or 0.0, False))
    n_shards = max(math.ceil(n / shard_rows), 1)
    n_blocks = max(math.ceil(queries / block_queries), min(MOST_BLOCKS, math.ceil(queries / LEAST_BLOCK)), 1)
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", deal(n_shards, 1).alias("shard"), every(n_blocks).alias("block"))
    right = rows.where(is_query).select("vec_id", "v", deal(n_blocks, 2).alias("block"), every(n_shards).alias("shard"))

    def run(x: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(asked):
            x, asked = _ids_once(x), _ids_once(asked)
            found = search(asked.vec_id.to_numpy(), matrix(list(asked.v), width), x.vec_id.to_numpy(), matrix(list(x.v), width), rotations, most, k)
        return pd.DataFrame({"query_id": [f[0] for f in found], "vec_id": [f[1] for f in found], "score": [f[2] for f in found]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ("shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def coded(vectors: DataFrame, rotations: np.ndarray, most: float) -> DataFrame:
    """vec_id and code of every usable vector, by rotations learned elsewhere: the index as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1).to_pylist(), len(rotations) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes(augmented(x, most, False), rotations)], pa.binary())], names=["vec_id", "code"])

    return usable(vectors).mapInArrow(run, "vec_id long, code binary")
