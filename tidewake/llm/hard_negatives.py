"""Hard negatives by a distributed kNN join over Voronoi cells.

Inner products become distances: candidates x get one more component sqrt(M^2 - |x|^2), M being the largest norm, and anchors
a zero there, so |a - x|^2 = |a|^2 + M^2 - 2 a.x.  PIVOTS candidates at most are pivots; anchors belong to the cell of their
nearest pivot, and a cell's anchors are a group.  By the triangle inequality a candidate at distance d from a group's pivot is
between d - R and d + R from each of its anchors, R being the group's radius.  So it goes only to the groups that it might serve:

* positives: groups are made by cell and label.  The POSITIVES nearest of a label are within the (POSITIVES + 1)th smallest d of
  that label's candidates in the same cell, plus R (one of them may be the anchor itself); what is farther is not sent.
* negatives: the score window of each anchor and positive is a ring of distances; a candidate whose d - R .. d + R misses
  the span of all rings of a group is not sent there.

What is sent is joined exactly, in integers, in tasks of at most SHARD_ROWS candidates and BLOCK_ANCHORS anchors, so a hot cell is
several tasks; their best are merged by score, then vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .multi_index import augmented, matrix

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
WINDOW = (50, 95)  # percent of the positive's score
PIVOTS = 256
ANCHORS_A_PIVOT = 512  # of fewer anchors there are fewer pivots
SHARD_ROWS = 16_384
BLOCK_ANCHORS = 1024
CHUNK = 64  # anchors whose scores with a shard are held at once
SLACK = 1e-6  # share of M: distances are rounded, scores are not


def usable(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label and v (floor(SCALE * x) of each component), one row a vec_id: of rows that repeat one, the smallest by label,
    then vector.  Rows with a null label, id or vector, or with a null, NaN or infinite component, are left out."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")) if label is None else label
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(whole)
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), v.alias("v")).alias("x"))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.label", "x.v")


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of integer vectors, exact: in doubles, or in Python's integers where those do not hold them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a @ x.T
    return np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(x).T


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k and scores.dtype != object:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _placed(rows: DataFrame, pivots: np.ndarray, most: float, anchors: bool) -> DataFrame:
    """rows with cell, the nearest pivot, and d: its distance for anchors, the distances to all pivots for candidates."""
    width = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = augmented(matrix(b.column(b.schema.get_field_index("v")).to_pylist(), width), most, anchors)
            far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
            cell = far.argmin(1).astype(np.int32)
            d = pa.array(far[np.arange(len(far)), cell]) if anchors else pa.array(list(far), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), d], names=[*b.schema.names, "cell", "d"])

    return rows.mapInArrow(run, f"vec_id long, label long, v array<double>, cell int, d {'double' if anchors else 'array<double>'}")


def _dealt(anchors: DataFrame, sent: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by keys cut into blocks and shards of bounded size, each block with a copy of each shard.  The
    sizes of the groups, a row each, are counted first."""
    sizes = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ANCHORS).cast("int").alias("blocks"))
    sizes = stored(sizes.join(sent.groupBy(*keys).agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")), keys), "negatives-sizes")
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hint = small(sizes)
    left = anchors.join(hint, keys).withColumn("block", part("blocks")).withColumn("shard", every("shards"))
    right = sent.join(hint, keys).withColumn("shard", part("shards")).withColumn("block", every("blocks"))
    return left.drop("blocks", "shards"), right.drop("blocks", "shards")


def _best(found: DataFrame, by: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], width: int, pick: Callable[[tuple, np.ndarray, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """The rows that pick finds for each anchor (its row, and its scores with a shard's candidates), joined task by task."""

    def run(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(x):
            v = matrix(list(x.v), width)
            for at in range(0, len(a), CHUNK):
                part = a.iloc[at : at + CHUNK]
                for anchor, row in zip(part.itertuples(index=False), _scores(matrix(list(part.v), width), v)):
                    found += pick(anchor, row, x)
        return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")], dtype="int64")

    keys = [*keys, "block", "shard"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def positives(anchors: DataFrame, candidates: DataFrame, most: float, width: int) -> DataFrame:
    """anchor_id, positive_id and positive_score of each anchor's nearest other rows of its label."""
    groups = anchors.groupBy("cell", "label").agg(F.max("d").alias("radius"))
    # Any POSITIVES + 1 candidates bound the distance: those of a group's own cell do, where there are so many.
    own = candidates.select("label", "cell", F.get("d", "cell").alias("far"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "label").orderBy("far"))).where(F.col("rank") <= POSITIVES + 1)
    kth = own.where(F.col("rank") == POSITIVES + 1).select("cell", "label", "far")
    upto = (F.coalesce("far", F.lit(float("inf"))) + 2 * F.col("radius") + SLACK * most).alias("upto")
    groups = small(stored(groups.join(kth, ["cell", "label"], "left").select("cell", "label", upto), "negatives-groups"))
    sent = candidates.drop("cell").join(groups, "label").where(F.get("d", "cell") <= F.col("upto")).select("vec_id", "label", "v", "cell")
    left, right = _dealt(anchors.select("vec_id", "label", "v", "cell"), sent, ["cell", "label"])

    def pick(anchor: tuple, scores: np.ndarray, x: pd.DataFrame) -> list[tuple]:
        ids = x.vec_id.to_numpy()
        other = np.flatnonzero(ids != anchor.vec_id)
        return [(anchor.vec_id, int(ids[i]), int(scores[i])) for i in other[_first(scores[other], ids[other], POSITIVES)]]

    found = _pairs(left, right, ["cell", "label"], width, pick, "anchor_id long, positive_id long, positive_score long")
    return _best(found, ["anchor_id"], "positive_score", "positive_id", POSITIVES).drop("rank")


def negatives(anchors: DataFrame, candidates: DataFrame, most: float, width: int) -> DataFrame:
    """anchor_id, positive_id, negative_id, positive_score, negative_score of the best rows of another label in the window of each
    positive.  anchors have found, an array of positive_id and positive_score."""
    low, high = WINDOW
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    ring = lambda best, share: F.sqrt(F.greatest(square + most * most - 2 * best * share / 100.0, F.lit(0.0)))
    best = F.array_max(F.transform("found", lambda x: x["positive_score"]))
    worst = F.array_min(F.transform("found", lambda x: x["positive_score"]))
    groups = anchors.groupBy("cell").agg(F.max("d").alias("radius"), F.min(ring(best, high)).alias("lo"), F.max(ring(worst, low)).alias("hi"))
    slack = F.col("radius") + SLACK * most
    spans = groups.select("cell", (F.col("lo") - slack).alias("lo"), (F.col("hi") + slack).alias("hi")).collect()  # a row a pivot at most
    serves = F.array(*(F.when(F.get("d", F.lit(g.cell)).between(g.lo, g.hi), g.cell) for g in spans)).cast("array<int>")
    sent = candidates.select("vec_id", "label", "v", F.explode(F.array_compact(serves)).alias("cell"))
    left, right = _dealt(anchors.select("vec_id", "label", "v", "cell", "found"), sent, ["cell"])

    def pick(anchor: tuple, scores: np.ndarray, x: pd.DataFrame) -> list[tuple]:
        ids, other, out = x.vec_id.to_numpy(), x.label.to_numpy() != anchor.label, []
        for positive in anchor.found:
            score = int(positive["positive_score"])
            if scores.dtype == object:
                at = np.array([i for i in np.flatnonzero(other) if low * score <= 100 * scores[i] <= high * score], np.int64)
            else:
                at = np.flatnonzero(other & (100 * scores >= low * score) & (100 * scores <= high * score))
            out += [(anchor.vec_id, int(positive["positive_id"]), int(ids[i]), score, int(scores[i])) for i in at[_first(scores[at], ids[at], NEGATIVES)]]
        return out

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    return _best(_pairs(left, right, ["cell"], width, pick, schema), ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)


def mined(vectors: DataFrame, is_anchor: Column | None = None, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its POSITIVES nearest other
    rows of its label, the NEGATIVES highest-scoring rows of other labels between WINDOW percent of the positive's score.

    Anchors are the rows for which is_anchor holds (by default vec_id divisible by ANCHOR_EVERY).  See usable() for nulls and repeated
    rows; scores that tie are ordered by vec_id.  No anchors or no candidates, no rows; other columns play no part."""
    rows = stored(usable(vectors, label), "negatives-rows")
    is_anchor = F.col("vec_id") % ANCHOR_EVERY == 0 if is_anchor is None else is_anchor
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    n, width, most = rows.agg(F.count(F.when(is_anchor, 1)), F.max(F.size("v")), F.max(norm)).first()
    width, most = width or 1, most or 0.0
    k = max(1, min(PIVOTS, math.ceil(n / ANCHORS_A_PIVOT)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(k).collect()  # PIVOTS vectors at most
    pivots = augmented(matrix([r.v for r in chosen] or [[]], width), most, False)
    anchors = stored(_placed(rows.where(is_anchor), pivots, most, True), "negatives-anchors")
    candidates = stored(_placed(rows, pivots, most, False), "negatives-candidates")
    found = stored(positives(anchors, candidates, most, width), "negatives-positives")
    listed = found.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found"))  # POSITIVES at most
    out = negatives(stored(anchors.join(listed, "vec_id"), "negatives-asked"), candidates, most, width)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
