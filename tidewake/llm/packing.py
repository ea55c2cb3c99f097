"""Packing by concatenate and cut.

Pass 1 encodes every document once, and writes the ids with each document's offset in its partition.  The partitions'
token totals, one row each, are summed to prefixes: a partition's global offset.  Pass 2 cuts the one global stream into
windows of ``length`` ids; a document that crosses window boundaries leaves a record per piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy
from .tokens import CACHED_CHUNKS, encoder, tokenizer_path

LENGTH = 2048
END_ID = 1
PAD_ID = 0
BROADCAST_PARTS = 1_000_000
"""Rows of 16 bytes that are broadcast at most."""


def encoded(docs: DataFrame, end_id: int, path: str | None = None, cached_chunks: int = CACHED_CHUNKS) -> DataFrame:
    """doc_id, part, before (ids of the partition's earlier rows), n and ids (two bytes an id where they fit, else four).

    Stored, so that the offsets computed from it hold for every later reading, whatever is lost meanwhile.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        enc = encoder(path, cached_chunks)
        mark = bytes([enc.width])  # says how wide the ids are
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = b.slice(at, 512)
                ids = enc.encode_narrow(rows.column(1).to_pylist(), end_id)
                n = np.array([len(x) // enc.width for x in ids], np.int64)
                offset = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), part)), pa.array(offset), pa.array(n), pa.array([mark + x for x in ids], pa.binary())],
                    names=["doc_id", "part", "before", "n", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(tidy(run), "doc_id long, part long, before long, n long, ids binary"), "ids")


def widened(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype("<u4")


def offsets(ids: DataFrame) -> DataFrame:
    """part and base: the ids before each partition.  One row per input partition, so small beside the data."""
    totals = ids.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))


def pieces(ids: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """A record per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids, or their crc32."""
    last = ("ids_crc32", "long", pa.int64(), lambda x: zlib.crc32(x)) if digest else ("ids", "binary", pa.binary(), lambda x: x.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                cols: list[list] = [[] for _ in range(7)]
                for doc, first, data in zip(*(rows.column(i).to_pylist() for i in range(3))):
                    x = widened(data)
                    cuts = [0, *range(length - first % length, len(x), length), len(x)]
                    for a, z in zip(cuts, cuts[1:]):
                        pos = first + a
                        for c, v in zip(cols, (doc, a, z - a, len(x), pos // length, pos % length, last[3](x[a:z]))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], last[2])],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", last[0]],
                )

    # one small row per input partition: broadcast, unless there are more of them than a broadcast should hold
    base = offsets(ids)
    few = ids.select("part").distinct().count() <= BROADCAST_PARTS
    placed = ids.join(F.broadcast(base) if few else base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "ids")
    return placed.mapInArrow(tidy(run), f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {last[0]} {last[1]}")


def packed(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, digest: bool = False, cached_chunks: int = CACHED_CHUNKS) -> DataFrame:
    """The pieces of all documents.  Null texts hold only the end id; null ids and repeated rows are kept as they are;
    no documents, no pieces.  All sequences but the last are full, so padding is below one window for the corpus.

    ``cached_chunks`` bounds what a worker remembers of texts, about 150 bytes a chunk and twice as many chunks."""
    return pieces(encoded(docs, end_id, path, cached_chunks), length, digest)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id and tokens array<int>: the pieces put together; padded, unless its length is a power of two."""

    def join(parts: list[bytes]) -> bytes:
        return b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                x = np.frombuffer(join([p["ids"] for p in parts]), "<u4").astype(np.int32)
                pad = 0 if len(x) & (len(x) - 1) == 0 else length - len(x)
                out.append(np.concatenate([x, np.full(pad, pad_id, np.int32)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["sequence_id", "tokens"])

    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.mapInArrow(tidy(run), "sequence_id long, tokens array<int>")
