"""Prefix trie of conversations from the sorted conversations and their longest common prefixes (LCP).

Conversations are rebuilt, reduced to distinct sequences of turn digests, sorted, and numbered r = 0, 1, ...; L[r] is the
number of turns that r shares with r - 1 (L[0] = -1).  The trie is the Cartesian tree of L: around each r stands the widest
interval whose later members share at least L[r] turns, from the previous smaller value of L to the next smaller one.
Those two are found in parallel: in blocks of BLOCK values by a stack, and for what a block leaves open by a search over the
blocks' minima, the minima of the minima and so on, one equi-join a level.  Intervals of equal ends are one node; the
depths between a node and its parent, which no L names, are expanded from the turns of the interval's first member.  Counts
over an interval are sums and minima of block ends and whole blocks, over the same levels.

Every group is bounded: copies of a conversation are counted before anything else, a block holds BLOCK values, a sort key
WIDTH digests (longer sequences are first cut into pieces that are ranked, so that a key is a sequence of ranks), and the ids
of a hot conversation are hashed as a stream of buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tasks import numbered
from .common import small, stored

BLOCK = 256
WIDTH = 1024
EVERY = 20  # a conversation takes its first turns from the one whose id is the next smaller multiple
HEADS = 4  # it takes crc32(id) % HEADS of them
ID_BUCKET = 4096
WORD = r"[^\x20\x09-\x0D]+"


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0, by turn, null first, then by digest), g (a digest of role and text) and words of each turn.

    A null role or text is empty.  Rows without conv_id are left out; rows that repeat a turn are turns of their own."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    g = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", g.alias("g"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "g")) - 1).select("conv_id", "i", "g", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, i, g, words) of the rebuilt conversations, and every conv_id with the length n of its own."""
    rows = stored(digested(conversations), "trie-turns")
    n = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = n.withColumns({"base": F.col("conv_id") - F.col("conv_id") % EVERY, "h": h})
    lent = n.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))
    convs = stored(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("n")), "trie-convs")
    heads = rows.where((F.col("conv_id") % EVERY == 0) & (F.col("i") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    head = convs.where("taken > 0").join(heads, "base").where("i < taken").select("conv_id", "i", "g", "words")
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "g", "words")
    return head.unionByName(own), convs.select("conv_id", "n")


def sequences(rows: DataFrame, width: int) -> DataFrame:
    """rep and seq, an array of at most ``width`` symbols, which sort as the sequences of g by i of each rep do."""
    s, most = rows.select("rep", "i", "g"), rows.agg(F.max("i")).first()[0]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda x: x["g"])
    while most is not None and most >= width:
        pieces = stored(s.groupBy("rep", F.floor(F.col("i") / width).cast("int").alias("piece")).agg(listed.alias("seq")), "trie-pieces")
        ranks = numbered(pieces.select("seq").distinct(), "seq").select("seq", "_i")
        rank = F.unhex(F.lpad(F.hex("_i"), 16, "0"))
        s, most = pieces.join(ranks, "seq").select("rep", F.col("piece").alias("i"), rank.alias("g")), most // width
    return s.groupBy("rep").agg(listed.alias("seq"))


def levels(values: DataFrame, n: int, sums: list[str], mins: list[str], block: int) -> list[DataFrame]:
    """Values at r = 0 .. n - 1 in blocks (k and an array a column; of sums, what they add up to within the block), then the
    blocks' sums and minima in blocks, and so on up to a single block."""
    out, level = [], values.select(F.col("r").alias("e"), *sums, *mins)
    k = F.floor(F.col("e") / block).cast("long")
    while True:
        w = Window.partitionBy("k").orderBy("e")
        rows = level.withColumn("k", k).withColumns({c: F.sum(c).over(w) for c in sums})
        packed = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("e", *sums, *mins))).alias("x"))
        out.append(stored(packed.select("k", *(F.col("x")[c].alias(c) for c in (*sums, *mins))), "trie-level"))
        n = math.ceil(n / block)
        if n <= 1:
            return out
        level = out[-1].select(F.col("k").alias("e"), *(F.element_at(c, -1).alias(c) for c in sums), *(F.array_min(c).alias(c) for c in mins))


def over_intervals(intervals: DataFrame, blocks: list[DataFrame], sums: list[str], mins: list[str], block: int) -> DataFrame:
    """Distinct (a, b) with the sums and minima of the values at a .. b: the ends' blocks in part, those between one level up."""
    ask = intervals.select("a", "b", F.col("a").alias("lo"), F.col("b").alias("hi"))
    lo, hi = F.floor(F.col("lo") / block).cast("long"), F.floor(F.col("hi") / block).cast("long")
    off = lambda c: (F.col(c) % block).cast("int")
    piece = lambda k, x, y: F.struct(k.alias("k"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    parts = []
    for level in blocks:
        pieces = F.when(lo == hi, F.array(piece(lo, off("lo"), off("hi")))).otherwise(F.array(piece(lo, off("lo"), F.lit(block - 1)), piece(hi, F.lit(0), off("hi"))))
        met = ask.select("a", "b", F.explode(pieces).alias("p")).select("a", "b", "p.*").join(level, "k")
        total = lambda c: F.get(c, F.col("y")) - F.coalesce(F.when(F.col("x") > 0, F.get(c, F.col("x") - 1)), F.lit(0))
        parts.append(met.select("a", "b", *(total(c).alias(c) for c in sums), *(F.array_min(F.slice(c, F.col("x") + 1, F.col("y") - F.col("x") + 1)).alias(c) for c in mins)))
        ask = ask.where(hi - lo >= 2).select("a", "b", (lo + 1).alias("lo"), (hi - 1).alias("hi"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in mins))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (k, first r, values of L) to a row a value: r, l, k, and the place and value of the previous and of the next
    smaller value, null where it is not in the block."""
    for b in batches:
        for k, first, values in zip(*(c.to_pylist() for c in b.columns)):
            n = len(values)
            left, right, stack = [None] * n, [None] * n, []
            for i, v in enumerate(values):
                while stack and values[stack[-1]] > v:
                    right[stack.pop()] = i
                top = stack[-1] if stack else None
                left[i] = left[top] if top is not None and values[top] == v else top
                stack.append(i)
            at = lambda xs: [None if x is None else first + x for x in xs]
            of = lambda xs: [None if x is None else values[x] for x in xs]
            cols = [range(first, first + n), values, [k] * n, at(left), of(left), at(right), of(right)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["r", "l", "k", "a", "al", "b", "bl"])


def _search(asked: DataFrame, blocks: list[DataFrame], block: int, right: bool) -> DataFrame:
    """(k, l) with the place and value of the first value below l in the blocks after k, or of the last one before k; without
    one no row.  Up the levels until a block's minima hold such a value, and down again into it."""
    open_, found = asked.select("k", "l", F.col("k").alias("e")), None
    below = lambda c: F.transform(c, lambda x: x < F.col("l"))
    for t, level in enumerate(blocks[1:], 1):
        here = open_.withColumns({"j": F.floor(F.col("e") / block).cast("long"), "o": (F.col("e") % block).cast("int")})
        met = here.join(level.select(F.col("k").alias("j"), F.col("l").alias("x")), "j")
        rest = F.slice("x", F.col("o") + 2, block) if right else F.reverse(F.slice("x", 1, F.col("o")))
        at = F.array_position(below(rest), True).cast("int")
        met = stored(met.withColumn("at", at).drop("x"), "trie-search")
        open_ = met.where("at = 0").select("k", "l", F.col("j").alias("e"))
        e = F.col("j") * block + (F.col("o") + F.col("at") if right else F.col("o") - F.col("at"))
        hit = met.where("at > 0").select("k", "l", F.lit(t - 1).alias("t"), e.alias("e"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return asked.select("k", "l", F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("v")).limit(0)
    for t in range(len(blocks) - 2, -1, -1):  # a place e of level t + 1 is block e of level t
        met = found.where(F.col("t") == t).join(blocks[t].select(F.col("k").alias("e"), F.col("l").alias("x")), "e")
        i = F.array_position(below(F.col("x") if right else F.reverse("x")), True).cast("int")
        i = i - 1 if right else F.size("x") - i
        down = met.select("k", "l", F.lit(t - 1).alias("t"), (F.col("e") * block + i).alias("e"), F.get("x", i).alias("v"))
        if t == 0:
            return down.select("k", "l", F.col("e").alias("at"), "v")
        found = found.where(F.col("t") < t).unionByName(down.drop("v"))
    raise AssertionError


def nearest_smaller(blocks: list[DataFrame], n: int, block: int) -> DataFrame:
    """r, l, a, al, b, bl of each r: the previous and the next smaller value of L and their places; n and -1 without a next."""
    rows = stored(blocks[0].select("k", (F.col("k") * block).alias("first"), "l").mapInArrow(_within, "r long, l int, k long, a long, al int, b long, bl int"), "trie-within")
    for side, value, right in (("a", "al", False), ("b", "bl", True)):
        asked = rows.where(F.col(side).isNull()).select("k", "l").distinct()  # as many a block as it has open values
        found = _search(asked, blocks, block, right)
        rows = rows.join(small(stored(found, "trie-found")), ["k", "l"], "left").withColumns({side: F.coalesce(side, "at"), value: F.coalesce(value, "v")}).drop("at", "v")
    return rows.select("r", "l", "a", "al", F.coalesce("b", F.lit(n)).alias("b"), F.coalesce("bl", F.lit(-1)).alias("bl"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, bucket, ids) ordered by r and bucket to r and the SHA-256 of its ids; all that is held is one digest."""
    last, digest = None, None
    for b in batches:
        rs, hs = [], []
        for r, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if r != last:
                if digest is not None:
                    rs.append(last)
                    hs.append(digest.hexdigest())
                last, digest = r, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(rs, pa.int64()), pa.array(hs, pa.string())], names=["r", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([digest.hexdigest()])], names=["r", "sha"])


def id_hashes(members: DataFrame) -> DataFrame:
    """r and the SHA-256 of the decimal ids of its members (r, conv_id), ascending, joined by commas.  Ids are first joined in
    buckets of ID_BUCKET neighbouring ids, so a hot r is a stream of few rows."""
    buckets = members.groupBy("r", F.floor(F.col("conv_id") / ID_BUCKET).alias("bucket")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    text = buckets.select("r", "bucket", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return text.repartition("r").sortWithinPartitions("r", "bucket").mapInArrow(_hashed, "r long, sha string")


def nodes(conversations: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """A row per node, which is a distinct sequence of the first ``depth`` turns of rebuilt conversations: conv_id (its smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation without turns left is a member of the root.  No conversations, no rows.  See digested() for nulls, ties
    and repeated rows; other columns play no part."""
    turns, convs = rebuilt(conversations)
    turns = stored(turns, "trie-rebuilt")
    mark = [F.bit_xor(F.xxhash64(*c)).alias(x) for x, c in (("x", (F.lit(1), "i", "g")), ("y", ("g", "i", F.lit(2))))]
    marks = turns.groupBy("conv_id").agg(*mark)
    convs = stored(convs.join(marks, "conv_id", "left").na.fill(0, ["x", "y"]), "trie-marked")
    kinds = stored(convs.groupBy("n", "x", "y").agg(F.count("*").alias("w"), F.min("conv_id").alias("rep")), "trie-kinds")
    own = stored(turns.join(kinds.select(F.col("rep").alias("conv_id"), F.col("rep")), "conv_id").select("rep", "i", "g", "words"), "trie-own")

    keyed = kinds.join(sequences(own, width), "rep", "left").withColumn("seq", F.coalesce("seq", F.array().cast("array<binary>")))
    order = stored(numbered(keyed, "seq", "rep").select((F.col("_i") - 1).alias("r"), "rep", "n", "x", "y", "w"), "trie-order")
    m = order.count()
    turns = stored(own.join(order.select("rep", "r"), "rep").select("r", "i", "g", "words"), "trie-ordered")
    before = turns.select((F.col("r") + 1).alias("r"), "i", F.col("g").alias("b"))
    shared = turns.join(before, ["r", "i"], "left").where("b is null or b <> g").groupBy("r").agg(F.min("i").alias("l"))
    l = F.when(F.col("r") == 0, -1).otherwise(F.coalesce("l", F.lit(0))).cast("int")  # noqa: E741
    places = order.join(shared, "r", "left").withColumn("l", l)
    after = places.select((F.col("r") - 1).alias("r"), F.col("l").alias("next"))
    places = stored(places.join(after, "r", "left").withColumn("next", F.coalesce("next", F.lit(-1))), "trie-places")

    near = stored(nearest_smaller(levels(places.select("r", "l"), m, [], ["l"], block), m, block), "trie-near")
    wide = near.where("r > 0").select("a", (F.col("b") - 1).alias("b"), F.col("l").alias("d"), F.greatest("al", "bl").alias("p")).distinct()
    counted = levels(places.select("r", "w", (F.col("next") < F.col("n")).cast("long").alias("leaves"), "rep"), m, ["w", "leaves"], ["rep"], block)
    wide = wide.join(over_intervals(wide, counted, ["w", "leaves"], ["rep"], block), ["a", "b"])
    single = places.select(F.col("r").alias("a"), F.col("r").alias("b"), F.col("n").alias("d"), F.greatest("l", "next").alias("p"), "w", F.lit(1).cast("long").alias("leaves"), "rep").where("d > p")
    each = wide.unionByName(single).withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("d"))))
    words = turns.select(F.col("r").alias("a"), (F.col("i") + 1).alias("depth"), "words")
    each = each.join(words, ["a", "depth"], "left").withColumn("own", (F.col("w") - 1) * F.coalesce("words", F.lit(0)))
    each = stored(each.select("a", "b", "depth", "w", "leaves", "rep", "own"), "trie-each")

    spent = places.select("r").join(each.groupBy(F.col("a").alias("r")).agg(F.sum("own").alias("own")), "r", "left").na.fill(0, ["own"])
    spent = stored(spent, "trie-spent")
    inside = over_intervals(each.where("a < b").select("a", "b").distinct(), levels(spent, m, ["own"], [], block), ["own"], [], block)
    inside = inside.unionByName(spent.select(F.col("r").alias("a"), F.col("r").alias("b"), "own")).withColumnRenamed("own", "inside")

    down = Window.partitionBy("a").orderBy("depth")
    above = F.coalesce(F.sum("own").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumns({"above": above, "up": F.lag("rep").over(down)})
    branches = near.where("r > 0").groupBy("a", F.col("l").alias("depth")).agg(F.count("*").alias("branches"))
    parents = near.where("r > 0").join(each.select("a", F.col("depth").alias("l"), F.col("rep").alias("parent")), ["a", "l"]).select(F.col("r").alias("a"), (F.col("l") + 1).alias("depth"), "parent")
    members = convs.join(small(order.select("r", "n", "x", "y")), ["n", "x", "y"]).select("r", "conv_id")
    ends = places.select("r", F.col("n").alias("depth")).join(id_hashes(members), "r").withColumnRenamed("r", "a")
    lengths = places.select(F.col("r").alias("a"), "n")
    out = each.join(inside, ["a", "b"]).join(lengths, "a").join(branches, ["a", "depth"], "left").join(parents, ["a", "depth"], "left").join(ends, ["a", "depth"], "left")

    long = lambda c: c.cast("long")
    children: Column = (F.col("depth") < F.col("n")).cast("long") + F.coalesce("branches", F.lit(0))
    return out.select(
        F.col("rep").alias("conv_id"), long(F.col("depth")).alias("depth"), F.coalesce("up", "parent").alias("parent_conv_id"), long(F.col("w")).alias("n_convs"), long(children).alias("n_children"),
        long(F.col("leaves")).alias("n_leaves"), long(F.col("inside") - F.col("above")).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
