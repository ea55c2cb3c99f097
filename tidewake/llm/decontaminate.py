"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 2 * STRIDE words, one every STRIDE words, over all documents, and the benchmark's items.  Their
TF-IDF vectors have the benchmark's words as terms, weighted by 1 / sqrt(occurrences), under which the terms' columns
have about equal norms; terms that occur more often than in MAX_SHARE of the passages are left out, but for each item's
RARE rarest.  A randomised SVD in one pass gives the latent space: with a Gaussian test matrix W every partition sums
B = A' (A W) over its own passages, the sums are added by term, and B (W' B)^-1/2 spans the leading right singular
vectors (the Nystroem form).  Its rank, items + OVERSAMPLE, follows the number of items, so no item's direction is cut.  A passage
is too small a part of a long item to be near it: an item of more than LONG words is searched for by each 2 * STRIDE words
of its own as well, one of which starts within STRIDE / 2 words of some passage of a copy.
A passage is a candidate for an item if the cosine in the latent space is at least COSINE and its length there at least
LENGTH of the item's.  A candidate is a leak if the longest common subsequence of the item's words with the words around
the passage is at least LCS of the item, or at least LCS_ANSWER while the item's answer (its last sentence, or the column
``answer``) is found with at least ANSWER of its words in order.

The benchmark is handled in blocks of BLOCK_ITEMS items, long ones counted by their parts, each with its own latent space,
which bounds what is broadcast to about that many times LONG words, or one item's; the items come to the driver one block
at a time.  Texts are split into words once a block: what is stored are the terms'
numbers, 0 for any other word, which is all that the passages' vectors and the common subsequences depend on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, tidy

STRIDE = 16
MAX_SHARE = 0.01
RARE = 8
OVERSAMPLE = 16
BLOCK_ITEMS = 400
LONG = 6 * STRIDE
COSINE = 0.5
LENGTH = 0.25
LCS = 0.6
LCS_ANSWER = 0.5
ANSWER = 0.8
BATCH_WORDS = 400_000
SEED = 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the marks that end a phrase."""
    text = (text or "").lower()
    for mark in ".,;:!?\"()":
        text = text.replace(mark, " ")
    return text.split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_of(item: str, answer: str | None = None) -> list[str]:
    if answer:
        return words_of(answer)
    parts = [p for p in re.split(r"[.!?\n]", item) if p.strip()]
    return words_of(parts[-1]) if parts else []


def parts_of(words: list) -> list[list]:
    """What an item is searched for by: all of its words, and if they are many, each 2 * STRIDE of them."""
    return [words] + [words[i : i + 2 * STRIDE] for i in range(0, len(words), 2 * STRIDE) if len(words) > LONG]


@dataclass(frozen=True)
class Block:
    """Some items, their words and answers as terms (1..d; 0 stands for any other word)."""

    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    terms: dict[str, int]

    @classmethod
    def of(cls, rows: list) -> Block | None:
        items = [(r.item_id, words_of(r.text), answer_of(r.text, r["answer"] if "answer" in r else None)) for r in rows if r.text]
        items = [x for x in items if x[1]]
        if not items:
            return None
        terms = {w: i + 1 for i, w in enumerate(sorted({w for _, ws, answer in items for w in (*ws, *answer)}))}
        number = lambda ws: [terms[w] for w in ws]
        return cls([x[0] for x in items], [number(x[1]) for x in items], [number(x[2]) for x in items], terms)

    @property
    def width(self) -> str:
        """How a term's number is stored."""
        return "<u2" if len(self.terms) < 1 << 16 else "<u4"

    @property
    def parts(self) -> list[tuple[int, list[int]]]:
        """The items' parts, each with its item's place."""
        return [(i, part) for i, ws in enumerate(self.words) for part in parts_of(ws)]

    def vectors(self, weight: np.ndarray) -> np.ndarray:
        """A row per part."""
        parts = self.parts
        out = np.zeros((len(parts), len(self.terms) + 1))
        for i, (_, ws) in enumerate(parts):
            for t, n in Counter(ws).items():
                out[i, t] = n * weight[t]
        return out


@dataclass
class Cells:
    """A batch of documents in cells of STRIDE words; a passage is a cell and the next of its document, and has the first
    one's number.  Entries (cell, term) are those of the terms that have a weight, in order of place."""

    docs: list[np.ndarray]
    """the terms of each document's words"""
    cell: np.ndarray
    term: np.ndarray
    owner: np.ndarray
    """document of a cell"""
    first: np.ndarray
    """place of its first word in its document"""
    joined: np.ndarray
    """whether the next cell is of the same document"""
    passage: np.ndarray
    """whether a passage begins there: also at a document's only cell"""


def cells(docs: list[np.ndarray], used: np.ndarray) -> Iterator[Cells]:
    """In batches of about BATCH_WORDS words; a very long document makes a batch of its own.  used: by term."""
    held: list[np.ndarray] = []
    n = 0
    for i, d in enumerate(docs):
        held.append(d)
        n += len(d)
        if n >= BATCH_WORDS or i == len(docs) - 1:
            yield _batch(held, used)
            held, n = [], 0


def _batch(docs: list[np.ndarray], used: np.ndarray) -> Cells:
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs)
    count = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(docs)), count)
    base = np.cumsum(count) - count
    at = np.flatnonzero(used[ids])
    starts = np.cumsum(sizes) - sizes
    doc = np.searchsorted(np.cumsum(sizes), at, "right")
    cell = base[doc] + (at - starts[doc]) // STRIDE
    joined = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.empty(0, bool)
    first = (np.arange(len(owner)) - np.repeat(base, count)) * STRIDE
    return Cells(docs, cell, ids[at].astype(np.int32), owner, first, joined, joined | (first == 0))


def _sweep(c: Cells, rows: np.ndarray, size: int = 2048) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``size`` cells at a time, those without any term left out: (a, z, low, y) with y the sums of the passages' terms'
    rows, for the cells from low (a, or the one before) up to z."""
    for a in range(0, len(c.owner), size):
        z = min(a + size, len(c.owner))
        low, high = max(a - 1, 0), min(z + 1, len(c.owner))
        e0, e1 = np.searchsorted(c.cell, [low, high])
        if e0 == e1:
            continue
        cell = c.cell[e0:e1] - low
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        s = np.zeros((high - low + 1, rows.shape[1]), rows.dtype)
        s[cell[start]] = np.add.reduceat(rows[c.term[e0:e1]], start, axis=0)
        y = s[: z - low] * c.passage[low:z, None]
        y += s[1 : z - low + 1] * c.joined[low:z, None]
        yield a, z, low, y


def in_terms(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, hash (of the text) and ids (the terms of the text's words, block.width each), a stored row per row of docs."""
    given = docs.sparkSession.sparkContext.broadcast((block.terms, block.width))  # bounded by the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, width = given.value
        for b in batches:
            ids = []
            for t in b.column(2).to_pylist():
                words = words_of(t)
                ids.append(np.fromiter(map(terms.get, words, repeat(0)), width, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["doc_id", "hash", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return stored(rows.mapInArrow(tidy(run), "doc_id long, hash long, ids binary"), "benchmark-terms")


def _ids(b: pa.RecordBatch, width: str) -> list[np.ndarray]:
    return [np.frombuffer(x, width) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]


def term_counts(rows: DataFrame, block: Block) -> tuple[np.ndarray, int]:
    """How often each term occurs in rows (of in_terms), and the number of passages."""
    size, width = len(block.terms) + 1, block.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in batches:
            for ids in _ids(b, width):
                n = np.bincount(ids, minlength=size)
                n[0] = max(1, -(-len(ids) // STRIDE) - 1) * (len(ids) > 0)
                held += n
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    counted = rows.select("ids").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in counted:  # one row a term of the block
        out[r.term] = r.n
    return out, int(out[0])


def term_weights(block: Block, counts: np.ndarray, n: int) -> np.ndarray:
    """1 / sqrt(count) by term, the items counted in; zero for terms that are left out, and for those of answers only."""
    counts, there = counts.copy(), np.zeros(len(counts), bool)
    for ws in block.words:
        for t in ws:
            counts[t] += 1
            there[t] = True
    keep = there & (counts <= max(MAX_SHARE * n, 1))
    for _, ws in block.parts:
        keep[sorted(set(ws), key=lambda t: (counts[t], t))[:RARE]] = True
    weight = np.where(keep, 1 / np.sqrt(np.maximum(counts, 1)), 0)
    weight[0] = 0
    return weight


def latent_space(rows: DataFrame, block: Block, weight: np.ndarray) -> np.ndarray:
    """Orthonormal columns [term, direction] that span the leading right singular vectors of the weighted passages."""
    d, rank = len(weight), min(len(block.parts) + OVERSAMPLE, len(weight))
    given = rows.sparkSession.sparkContext.broadcast((weight.astype(np.float32), rank, block.width))  # bounded by the block

    def test_matrix(d: int, rank: int) -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((d, rank), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, rank, width = given.value
        w = test_matrix(len(weight), rank) * weight[:, None]
        held = np.zeros((len(weight), rank))
        for b in batches:
            for c in cells(_ids(b, width), weight > 0):
                _add(held, w, weight, c)
        at = np.flatnonzero(held.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.astype("<f8").tobytes() for x in held[at]], pa.binary())], names=["term", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for term, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(row, "<f8")
                sums[term] = sums[term] + x if term in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["term", "row"])

    parts = rows.select("ids").mapInArrow(tidy(run), "term long, row binary")
    total = np.zeros((d, rank))
    for r in parts.repartition("term").mapInArrow(tidy(add), "term long, row binary").collect():  # one row a term of the block
        total[r.term] = np.frombuffer(bytes(r.row), "<f8")
    w = test_matrix(d, rank).astype(float)
    own = block.vectors(weight)
    total += own.T @ (own @ w)
    inner = w.T @ total  # symmetric in exact arithmetic
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-300)
    basis, _ = np.linalg.qr(total @ (vectors[:, keep] / np.sqrt(values[keep])))
    return basis


def _add(held: np.ndarray, w: np.ndarray, weight: np.ndarray, c: Cells) -> None:
    """held += A' (A W) of the batch's passages."""
    for a, z, low, y in _sweep(c, w):
        both = y[a - low :].copy()  # a term counts in the passage that its cell begins, and in the one that it ends
        both[a == low :] += (y * c.joined[low:z, None])[: z - a - (a == low)]
        e0, e1 = np.searchsorted(c.cell, [a, z])
        term = c.term[e0:e1]
        if len(term):
            by = np.argsort(term, kind="stable")
            which, first = np.unique(term[by], return_index=True)
            held[which] += np.add.reduceat(both[(c.cell[e0:e1] - a)[by]], first, axis=0) * weight[which, None]


@dataclass(frozen=True)
class Model:
    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    width: str
    used: np.ndarray
    """By term, whether it has a weight"""
    basis: np.ndarray
    """[term, direction], rows multiplied by the terms' weights"""
    items: np.ndarray
    """The items' parts in the latent space, of length 1"""
    lengths: np.ndarray
    owner: list[int]
    """Of each part, its item's place"""

    def leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(document, item, cosine, share of the item in common order) of each leak, once per document and item."""
        found: list[tuple[int, int, float, float]] = []
        at = 0
        least = LENGTH * float(self.lengths.min())
        for c in cells(docs, self.used):
            best: dict[tuple[int, int], tuple[float, float]] = {}
            for a, _, low, y in _sweep(c, self.basis):
                length = np.linalg.norm(y, axis=1)
                long = np.flatnonzero(length >= max(least, 1e-12))
                long = long[long >= a - low]
                x, length = y[long], length[long]
                dot = x @ self.items.T
                near = (dot >= COSINE * length[:, None]) & (length[:, None] >= LENGTH * self.lengths)
                for row, part in zip(*np.nonzero(near)):
                    cell = low + int(long[row])
                    key = (int(c.owner[cell]), self.owner[part])
                    if key not in best and (share := self._verified(c, cell, key)) is not None:
                        best[key] = (float(dot[row, part] / length[row]), share)
            found += [(at + doc, item, *v) for (doc, item), v in best.items()]
            at += len(c.docs)
        return found

    def _verified(self, c: Cells, cell: int, key: tuple[int, int]) -> float | None:
        doc, i = key
        item, first = self.words[i], int(c.first[cell])
        words = c.docs[doc][max(0, first - len(item)) : first + 2 * STRIDE + len(item)].tolist()
        there = set(words)
        if sum(w in there for w in item) < LCS_ANSWER * len(item):  # it bounds the common subsequence
            return None
        share = lcs(item, words) / len(item)
        if share >= LCS:
            return share
        answer = self.answers[i]
        if share >= LCS_ANSWER and answer and lcs(answer, words) >= ANSWER * len(answer):
            return share
        return None


def fit(rows: DataFrame, block: Block) -> Model:
    """rows: of in_terms."""
    counts, n = term_counts(rows, block)
    weight = term_weights(block, counts, n)
    basis = latent_space(rows, block, weight)
    items = block.vectors(weight) @ basis
    lengths = np.linalg.norm(items, axis=1)
    unit = items / np.maximum(lengths, 1e-12)[:, None]
    return Model(block.ids, block.words, block.answers, block.width, weight > 0, (basis * weight[:, None]).astype(np.float32), unit.astype(np.float32), lengths.astype(np.float32), [i for i, _ in block.parts])


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in blocks.  Those whose text is null or without words are in none."""
    columns = ["item_id", "text", *([F.col("answer").cast("string").alias("answer")] if "answer" in benchmark.columns else [])]
    held: list = []
    parts = 0
    for r in benchmark.select(*columns).where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        held.append(r)
        parts += len(parts_of(words_of(r.text)))
        if parts >= BLOCK_ITEMS:
            if block := Block.of(held):
                yield block
            held, parts = [], 0
    if held and (block := Block.of(held)):
        yield block


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), item_id, cosine and lcs."""
    schema = "doc_id long, hash long, item_id long, cosine double, lcs double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        rows = in_terms(docs, block)
        given = docs.sparkSession.sparkContext.broadcast(fit(rows, block))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            m = given.value
            for b in batches:
                found = m.leaks(_ids(b, m.width))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array([m.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64())],
                    names=["doc_id", "hash", "item_id", "cosine", "lcs"],
                )

        out = out.unionByName(rows.mapInArrow(tidy(run), schema))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine and lcs (share of the item) of every document and item that it leaks.

    A row per input row and item: repeated rows report each.  Null and empty texts, and an empty benchmark, give none.
    """
    return _leaks(docs, benchmark).drop("hash")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns kept, without the documents that leak an item; a document is known by its id and its text's hash."""
    found = _leaks(docs, benchmark).select(F.col("doc_id").alias("_leak_id"), F.col("hash").alias("_leak_hash")).distinct()
    found = small(stored(found, "leaking"))
    same = docs["doc_id"].cast("long").eqNullSafe(found["_leak_id"]) & (F.xxhash64(docs["text"]) == found["_leak_hash"])
    return docs.join(found, same, "left_anti")
