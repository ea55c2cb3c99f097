"""Toxicity by class-conditional Kneser-Ney models.

The models are over the letters of a word: toxic expressions are rare, inflected and compounded, so what can be counted is
the letter n-gram.  All labelled training documents are counted by Spark.  The highest order, 5, counts occurrences by
class; orders 4 and 3 count continuations, the distinct letters that precede an n-gram in that class; order 2 and single
letters count them over both classes together, so that an expression rare in both backs off to shared counts and leaves
no difference.  Every order is interpolated with the one below, and letters with an even share for one that was never
seen, so that a context's probabilities sum to one.

The probability of a letter depends on its 5-gram alone.  So Spark joins the distinct 5-grams of the whole corpus with the
tables of counts, order by order, and what scoring needs is one number a 5-gram: the difference of its log-likelihoods.
Where a count proves the 5-grams few (BROADCAST_GRAMS), their numbers are broadcast and documents need no shuffle;
otherwise they are joined with the corpus's words, and the words with the documents, which gives the same.  No count is
cut off.

A document's features are length-normalised differences of log-likelihood: of its most toxic words (BEST), and of the
whole.  A logistic function of them, fitted on a bounded sample of training documents that the counts
leave out (CALIBRATE), gives the score; the sample takes both classes alike, which its constant undoes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, small, stored, tidy
from .quality import logistic
from .sampling import labelled_sample, with_labels

ORDER = 5
SHARED = 2
"""Up to this order both classes have one model."""
DISCOUNT = 0.75
BROADCAST_GRAMS = 4_000_000
BEST = (1, 2, 3, 5, 8)
"""Places among a document's words, from the most toxic one on, that are features."""
CACHED_WORDS = 400_000
CALIBRATE_TEXTS = 600
CALIBRATE_CHARS = 20_000
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
START, END = "\x01", "\x02"
"""A word's borders."""
COMMON, SALTS = 100_000, 64
"""A word in more documents than COMMON is dealt to SALTS tasks when words are joined with documents."""

_WORD = re.compile(r"[^\W\d_]+")
_CLASSES = ("toxic", "plain")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """word, toxic and plain: the counts of every word of the labelled documents (known: doc_id, toxic).  Of labelled
    documents of one text and class one is counted: copies say nothing new, but would make their own words look typical."""
    once = with_labels(docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")), known)
    once = once.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))
    first = stored(once.select("doc_id", "toxic").distinct(), "toxicity-once")
    rows = with_labels(docs.select("doc_id", "text"), first).select(F.col("toxic").cast("int").alias("toxic"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            t, p = [x[1] for x in held.values()], [x[0] for x in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(t, pa.int64()), pa.array(p, pa.int64())], names=["word", "toxic", "plain"])

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_of(text):
                    held.setdefault(w, [0, 0])[toxic] += 1
                if len(held) > CACHED_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = rows.mapInArrow(tidy(run), "word string, toxic long, plain long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def corpus_grams(docs: DataFrame) -> DataFrame:
    """gram: the distinct 5-grams of all documents' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        grams: set[str] = set()
        for b in batches:
            new = set()
            for text in b.column(0).to_pylist():
                new.update(words_of(text))
            new -= seen
            for w in new:
                w = START * (ORDER - 1) + w + END
                grams.update([w[i : i + ORDER] for i in range(len(w) - ORDER + 1)])
            seen |= new
            if len(seen) > CACHED_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string())], names=["gram"])
                seen, grams = set(), set()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string())], names=["gram"])

    return docs.where("text is not null").select("text").mapInArrow(tidy(run), "gram string").distinct()


def _grams_of(word: Column) -> Column:
    padded = F.concat(F.lit(START * (ORDER - 1)), word, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, toxic and plain: how often each 5-gram occurs in the words of either class."""
    each = words.select(F.explode(_grams_of(F.col("word"))).alias("gram"), *_CLASSES)
    return each.groupBy("gram").agg(*(F.sum(c).alias(c) for c in _CLASSES))


def _head(gram: Column, n: int) -> Column:
    return F.substring(gram, 1, n - 1)


def _tail(gram: Column, n: int) -> Column:
    return F.substring(gram, 2, n - 1)


def probabilities(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, toxic and plain: the probability of the last letter of each of ``grams`` (distinct 5-grams) after the others,
    by the counts of gram_counts.  Empty without counts."""
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # continuations: distinct letters before, by class or by both
        above, seen = by_order[n + 1], lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
        kinds = [seen(c) for c in _CLASSES] if n > SHARED else [F.count("*").alias(c) for c in _CLASSES]
        by_order[n] = above.groupBy(_tail(F.col("gram"), n + 1).alias("gram")).agg(*kinds)
    wanted = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = wanted[n + 1].select(_tail(F.col("gram"), n + 1).alias("gram")).distinct()
    whole = by_order[1].agg(F.sum("toxic").alias("n"), F.count("*").alias("kinds")).where("kinds > 0")  # one row, or none
    letters = wanted[1].join(by_order[1].select("gram", F.col("toxic").alias("k")), "gram", "left").join(F.broadcast(whole))
    even = DISCOUNT * F.col("kinds") / F.col("n") / (F.col("kinds") + 1)
    p = F.greatest(F.coalesce(F.col("k"), F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col("n") + even
    known = letters.select("gram", p.alias("toxic"), p.alias("plain"))
    for n in range(2, ORDER + 1):
        seen = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds")
        context = by_order[n].groupBy(_head(F.col("gram"), n).alias("_head")).agg(*(F.sum(c).alias(f"{c}_n") for c in _CLASSES), *(seen(c) for c in _CLASSES))
        own = by_order[n].select("gram", *(F.col(c).alias(f"{c}_k") for c in _CLASSES))
        lower = known.select(F.col("gram").alias("_tail"), *(F.col(c).alias(f"{c}_lower") for c in _CLASSES))
        rows = wanted[n].select("gram", _head(F.col("gram"), n).alias("_head"), _tail(F.col("gram"), n).alias("_tail"))
        rows = rows.join(own, "gram", "left").join(context, "_head", "left").join(lower, "_tail")

        def likely(c: str) -> Column:
            k, total, below = F.coalesce(F.col(f"{c}_k"), F.lit(0)), F.col(f"{c}_n"), F.col(f"{c}_lower")
            held = F.greatest(k - DISCOUNT, F.lit(0.0)) / total + DISCOUNT * F.col(f"{c}_kinds") / total * below
            return F.when(total > 0, held).otherwise(below)

        known = rows.select("gram", *(likely(c).alias(c) for c in _CLASSES))
    return known


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each 5-gram's word and letters' code points [gram, 5]."""
    text = "".join(START * (ORDER - 1) + w + END for w in words)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + ORDER for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    inside = np.flatnonzero(np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= ORDER - 1)
    return owner[inside], np.stack([x[inside - back] for back in range(ORDER - 1, -1, -1)], 1)


def _code(points: np.ndarray, multiplier: int) -> np.ndarray:
    code = np.zeros(len(points), np.uint64)
    for i in range(ORDER):
        code = code * np.uint64(multiplier) + points[:, i]
    return code


@dataclass(frozen=True)
class Differences:
    """The corpus's 5-grams as 64-bit codes, ascending and all different, and their differences of log-likelihood."""

    multiplier: int
    codes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, grams: list[str], values: np.ndarray) -> Differences:
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        multiplier = 0x9E3779B97F4A7C15
        while len(np.unique(codes := _code(points, multiplier))) < len(grams):  # two grams of one code: another code
            multiplier = (multiplier * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
        order = np.argsort(codes)
        return cls(multiplier, codes[order], values[order].astype(np.float32))

    def words(self, words: list[str]) -> np.ndarray:
        """[word, (difference of log-likelihood, toxic less plain; letters)]."""
        owner, points = _points(words)
        at = np.minimum(np.searchsorted(self.codes, _code(points, self.multiplier)), len(self.codes) - 1)
        return np.column_stack([np.bincount(owner, self.values[at], len(words)), [len(w) + 1 for w in words]])


class Scorer:
    """Keeps the words it has seen."""

    def __init__(self, differences: Differences):
        self.differences, self.at, self.known = differences, {}, np.empty((0, 2))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """[text, (the words at BEST places from the most toxic on, whole)] of differences a letter; zero where there is none."""
        each = [words_of(t) for t in texts]
        if len(self.at) > CACHED_WORDS:
            self.at, self.known = {}, np.empty((0, 2))
        new = list({w for ws in each for w in ws if w not in self.at})
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.known = np.concatenate([self.known, self.differences.words(new)])
        out = np.zeros((len(texts), len(BEST) + 1))
        for i, ws in enumerate(each):
            if ws:
                x = self.known[[self.at[w] for w in ws]]
                single = x[:, 0] / x[:, 1]
                most = min(BEST[-1], len(single))
                best = np.sort(np.partition(single, -most)[-most:])[::-1]
                out[i, :-1] = [best[k - 1] if k <= most else 0.0 for k in BEST]
                out[i, -1] = x[:, 0].sum() / x[:, 1].sum()
        return out


def word_rows(docs: DataFrame) -> DataFrame:
    """_row (a number of the row), doc_id, word, n and letters: each row's distinct words; one row without word if there
    are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts: dict[str | None, int] = {}
                for w in words_of(text) or [None]:
                    counts[w] = counts.get(w, 0) + 1
                words = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(words), pa.int64()), pa.array([doc] * len(words), pa.int64()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
                    names=["_row", "doc_id", "word", "n"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "_row long, doc_id long, word string, n long")


def joined_features(docs: DataFrame, differences: DataFrame) -> DataFrame:
    """doc_id and the features (an array) of each row, by joins with the table of differences (gram, value)."""
    rows = stored(word_rows(docs), "toxicity-words")
    words = rows.where("word is not null").groupBy("word").agg(F.count("*").alias("docs"))
    grams = words.select("word", "docs", F.explode(_grams_of(F.col("word"))).alias("gram"))
    known = grams.join(differences, "gram").groupBy("word", "docs").agg(F.sum("value").alias("value"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("docs") > COMMON, SALTS - 1).otherwise(0))))
    common = F.broadcast(words.where(F.col("docs") > COMMON).select("word", F.lit(True).alias("_common")))  # rows / COMMON at most
    rows = rows.join(common, "word", "left").withColumn("_salt", F.when(F.col("_common"), F.pmod("_row", F.lit(SALTS))).otherwise(0).cast("int"))
    rows = rows.join(known.select("word", "_salt", "value"), ["word", "_salt"], "left")
    letters = F.length("word") + 1
    ratio = F.coalesce(F.col("value") / letters, F.lit(0.0))
    most = BEST[-1]
    each = F.flatten(F.collect_list(F.when(F.col("word").isNotNull(), F.array_repeat(ratio, F.least("n", F.lit(most)).cast("int")))))
    out = rows.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.slice(F.sort_array(each, asc=False), 1, most).alias("best"),
        F.coalesce(F.sum(F.col("value") * F.col("n")) / F.sum(letters * F.col("n")), F.lit(0.0)).alias("whole"),
    )
    best = [F.coalesce(F.get("best", F.lit(k - 1)), F.lit(0.0)) for k in BEST]
    return out.select("doc_id", F.array(*best, "whole").alias("features"))


@dataclass(frozen=True)
class Model:
    """differences: gram and value of every 5-gram of the corpus; local, the same for broadcast, where they are few."""

    differences: DataFrame
    local: Differences | None
    weights: np.ndarray
    scale: np.ndarray


def differences(docs: DataFrame, counts: DataFrame) -> DataFrame:
    likely = probabilities(stored(corpus_grams(docs), "toxicity-corpus-grams"), counts)
    value = (F.log("toxic") - F.log("plain")).cast("float")  # as it is broadcast, so that joined tables give the same scores
    return stored(likely.select("gram", value.cast("double").alias("value")), "toxicity-differences")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Counts from the folds that are neither held out nor CALIBRATE; None without labelled words of both classes."""
    fold = crc_fold(F.col("doc_id"), FOLDS)
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labelled_sample(docs, known.where(fold == CALIBRATE), "toxic", CALIBRATE_TEXTS, CALIBRATE_CHARS)
    y = np.array([float(label) for label, _ in sample])
    if len(set(y.tolist())) < 2:
        return None
    counts = stored(gram_counts(word_counts(docs, known.where(~fold.isin(HELD_OUT, CALIBRATE)))), "toxicity-grams")
    table = differences(docs, counts)
    n = table.count()
    if not n:
        return None
    local = None
    if n <= BROADCAST_GRAMS:
        got = table.toPandas()
        local = Differences.of(got["gram"].tolist(), got["value"].to_numpy())
        x = Scorer(local).features([t for _, t in sample])
    else:
        spark = docs.sparkSession
        few = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(sample)], "doc_id long, text string")
        x = np.array([r.features for r in sorted(joined_features(few, table).collect(), key=lambda r: r.doc_id)])  # the sample's
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    return Model(table, local, logistic(x / scale, y, ridge=1e-3), scale)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.  Texts that are null or have no words score as a text of no
    difference; without a model every row scores 0; a null doc_id is never learnt from and not held out."""
    model = fit(docs, labels)
    if model is None:
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    elif model.local is None:
        each = joined_features(docs, model.differences)
        z = sum((F.col("features")[i] * float(w / s) for i, (w, s) in enumerate(zip(model.weights, model.scale))), F.lit(float(model.weights[-1])))
        found = each.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))).alias("score"))
    else:
        given = docs.sparkSession.sparkContext.broadcast((model.local, model.weights, model.scale))  # BROADCAST_GRAMS bounds it

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local, weights, scale = given.value
            scorer = Scorer(local)
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    rows = b.slice(at, 256)
                    z = scorer.features(rows.column(1).to_pylist()) / scale @ weights[:-1] + weights[-1]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
