"""Exact top-k inner products over integer vectors by MaxScore.

A query's terms are its dimensions.  Vectors are dealt into shards, queries into blocks, and each (shard, block) meets in
one task of a co-grouping, so both sides of a task are bounded by the parameters and nothing passes the driver.  In a
shard a term's bound is its largest possible contribution there, from the term's largest and smallest value.  Per query
the terms are ordered by what they can add to a row.  Those from which on a row with the least of all earlier terms could
still reach the k-th score are essential, and their postings are traversed for all rows; the others are probed, in steps,
only for rows whose partial score plus the remaining bounds still reaches the k-th score.  The k-th score known so far
rises meanwhile, so the split is made anew before each step.  The shards' winners are merged by score, then vec_id.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
QUERY_EVERY = 50
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
STEP = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x.  Vectors that are null or hold null, NaN or infinite
    components, and rows without vec_id, are left out."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector counts as padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which every partial sum is exact: float32, float64 or Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**24:
        return q.astype(np.float32), v.astype(np.float32)
    if most < 2**53:
        return q, v
    return np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(v)


def search(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, v: np.ndarray, k: int, steps: Counter | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows here, ties to the smaller vec_id.  ``steps`` is given the
    numbers of steps over essential and over probed terms."""
    steps = Counter() if steps is None else steps
    q, v = _exact(q, v)
    n, width = v.shape
    slack = 1e-12 if v.dtype == object else 0.0  # bounds are rounded to floats, scores are not
    postings = np.ascontiguousarray(v.T)
    high, low = v.max(0), v.min(0)
    found = []
    for query_id, weights in zip(query_ids.tolist(), q):
        others = vec_ids != query_id
        if not others.any():
            continue
        most, least = np.maximum(weights * high, weights * low), np.minimum(weights * high, weights * low)
        order = np.argsort(-(most - least).astype(np.float64), kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what the terms from here on add at most
        tail = np.append(np.cumsum(least[order][::-1])[::-1], 0)  # and at least
        rows, done = np.flatnonzero(others), min(STEP, width)
        head = order[:done]
        score = (weights[head] @ postings[head])[rows]
        # The k-th score has a first lower bound from rows that look best: their whole scores.
        best = rows[np.argpartition(-score.astype(np.float64), min(4 * k, len(rows)) - 1)[: 4 * k]]
        sure = np.sort((v[best] @ weights).astype(np.float64))[::-1]
        floor = sure[k - 1] - slack * abs(sure[k - 1]) if len(sure) >= k else -math.inf
        while done < width:
            part = order[done : done + STEP]
            # A term is essential while a row with the least of all terms before it could reach the k-th score by it and
            # the terms after it: then its postings are traversed for all rows.
            if tail[0] - tail[done] + rest[done] >= floor:
                score = score + (weights[part] @ postings[part])[rows]
                steps["essential"] += 1
            else:
                alive = score + rest[done] >= floor
                rows, score = rows[alive], score[alive]
                score = score + v[rows[:, None], part] @ weights[part]
                steps["probed"] += 1
            done += len(part)
            if len(rows) >= k:
                sure = float(np.partition(score.astype(np.float64), -k)[-k] + tail[done])
                floor = max(floor, sure - slack * abs(sure))
        top = np.lexsort((vec_ids[rows], -score.astype(np.float64) if score.dtype != object else [-int(s) for s in score]))[:k]
        found += [(query_id, int(vec_ids[rows[i]]), int(score[i])) for i in top]
    return found


def top_k(vectors: DataFrame, is_query: F.Column | None = None, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores (all, if there are fewer), ties to smaller vec_id.

    Queries are the rows for which is_query holds (by default vec_id divisible by QUERY_EVERY); candidates all rows of
    another vec_id.  Rows that repeat a vec_id count once, as the one with the smallest vector.  No vectors, no rows.
    """
    rows = quantised(vectors)
    is_query = F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query
    counted = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_shards = max(math.ceil(counted[0] / shard_rows), min(64, math.ceil(counted[0] / 128)), 1)
    n_blocks = max(math.ceil(counted[1] / block_queries), 1)
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    left = rows.select("vec_id", "v", shard.alias("shard"), seq(n_blocks).alias("block"))
    right = rows.where(is_query).select("vec_id", "v", block.alias("block"), seq(n_shards).alias("shard"))

    def once(x: pd.DataFrame) -> pd.DataFrame:
        if x.vec_id.is_unique:
            return x
        return x.assign(key=[tuple(v) for v in x.v]).sort_values(["vec_id", "key"]).drop_duplicates("vec_id")

    def run(x: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        x, queries = once(x), once(queries)
        width = max(max(map(len, x.v)), max(map(len, queries.v)), 1)
        found = search(queries.vec_id.to_numpy(), _matrix(queries.v, width), x.vec_id.to_numpy(), _matrix(x.v, width), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ("shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
