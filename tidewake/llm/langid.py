"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built of a bounded sample of labelled text (SAMPLE_TEXTS distinct texts, SAMPLE_SYMBOLS
symbols).  A text is cut greedily into the longest phrases that occur in the sample; a language's cross entropy is
phrases * log2(sample length) / symbols, and the language with the least wins.  Symbols are lower-cased letters; each run
of anything else is one separator.  Whole texts are parsed, in windows of WINDOW symbols that start a phrase each, so that
many windows advance together, one table look-up a symbol.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold
from .sampling import labelled_sample

SAMPLE_TEXTS = 120
SAMPLE_CHARS = 20_000
SAMPLE_SYMBOLS = 60_000
LETTERS = 90
"""Letters that have one symbol: the most frequent of the samples.  Every other letter is written as DIGITS hexadecimal digits, so
none shares its symbols with another, and an alphabet of any size costs no wider table."""
DIGITS = 6
WINDOW = 256
FOLDS, HELD_OUT = 5, 0

_built: dict[str, Parser] = {}


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions [state, symbol], -1 where there is none, of the automaton of all substrings."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = cur
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(steps), alphabet), -1, np.int32)
    for s, to in enumerate(steps):
        table[s, list(to)] = list(to.values())
    return table


class Parser:
    """The languages' automata in one table, and the parsing of many texts at once."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in sample})
        counts = Counter(c for _, t in sample for c in t.lower() if c.isalpha())
        # symbols: 0 separator, 2.. letters, then the digits of other letters, last: nothing (behind a window's end); 1 marks
        # a letter that is written in digits
        self.symbol = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            if chr(c).isalpha():
                self.symbol[c] = 1
        for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]):
            self.symbol[ord(c)] = i + 2
        self.alphabet = LETTERS + 2 + 16 + 1
        self.nothing = self.alphabet - 1
        tables, self.roots, self.bits, base = [], [], [], 0
        for lang in self.languages:
            own: list[int] = []
            for _, t in (x for x in sample if x[0] == lang):
                own += self.symbols(t).tolist()
                own.append(0)
                if len(own) >= SAMPLE_SYMBOLS:
                    break
            own = own[:SAMPLE_SYMBOLS]
            to = suffix_automaton(own, self.alphabet)
            # where a phrase ends, the next one starts with the symbol that did not fit: marked by the complement; a symbol that
            # is nowhere in the language's text is a phrase of its own, whose state, the last, nothing goes on from
            alone = len(to)
            first = np.where(to[0] >= 0, to[0], alone)
            to = np.vstack([to, np.full((1, self.alphabet), -1, np.int32)])
            to = np.where(to >= 0, to + base, ~(first + base)[None, :]).astype(np.int32)
            to[0] = first + base  # only a window's start, where no phrase ends
            to[:, self.nothing] = np.arange(len(to)) + base
            tables.append(to)
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(own))))
            base += len(to)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """The text's symbols, each run of separators as one, none at the ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = self.symbol[points]
        rare = np.flatnonzero(x == 1)
        if len(rare):
            width = np.where(x == 1, DIGITS, 1)
            at = (np.cumsum(width) - DIGITS)[rare]
            x = np.repeat(x, width)
            for i in range(DIGITS):
                x[at + i] = LETTERS + 2 + ((points[rare] >> 4 * (DIGITS - 1 - i)) & 15)
        keep = x > 0
        keep[1:] |= x[:-1] > 0
        x = x[keep]
        return x[: len(x) - 1] if len(x) and x[-1] == 0 else x

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Bits a symbol, [text, language]; NaN for texts without letters."""
        each = [self.symbols(t or "") for t in texts]
        sizes = np.array([len(x) for x in each])
        wins = -(-sizes // WINDOW)
        n = int(wins.sum())
        out = np.full((len(texts), len(self.languages)), np.nan)
        if not n or not self.languages:
            return out
        grid = np.full((n, WINDOW), self.nothing, np.uint8)
        at = 0
        for x, w in zip(each, wins.tolist()):
            grid[at : at + w].reshape(-1)[: len(x)] = x
            at += w
        owner = np.repeat(np.arange(len(texts)), wins)
        for i, (root, bits) in enumerate(zip(self.roots, self.bits)):
            phrases = np.zeros(n, np.int64)
            for a in range(0, n, 8192):
                part = np.ascontiguousarray(grid[a : a + 8192].T)
                state = np.full(part.shape[1], root, np.int64)
                count = np.ones(part.shape[1], np.int32)
                for row in part:
                    to = self.table[state * self.alphabet + row]
                    ended = to < 0
                    count += ended
                    state = np.where(ended, ~to, to).astype(np.int64)
                phrases[a : a + 8192] = count
            total = np.bincount(owner, phrases, len(texts))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[:, i] = np.where(sizes > 0, total * bits / sizes, np.nan)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and a score: how much more the next language needs, between 0.5 and 1; `und` scores 0."""
        e = self.entropies(texts)
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        for i, row in enumerate(e):
            if len(row) and not np.isnan(row[0]):
                order = np.argsort(row, kind="stable")
                langs[i] = self.languages[order[0]]
                score[i] = row[order[1]] / (row[order[0]] + row[order[1]]) if len(row) > 1 else 1.0
        return langs, score


def parser(sample: list[tuple[str, str]]) -> Parser:
    """This process's parser for the sample, built once."""
    key = hashlib.sha256(repr(sample).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Parser(sample)
    return _built[key]


def fit(docs: DataFrame, learn: Column) -> list[tuple[str, str]]:
    """The sample: texts of rows with a language for which ``learn`` holds."""
    return labelled_sample(docs.where(learn), None, "lang", SAMPLE_TEXTS, SAMPLE_CHARS)


def predictions(docs: DataFrame, sample: list[tuple[str, str]]) -> DataFrame:
    """doc_id, lang_pred and score of each row; `und` for null texts and those without letters, or without a sample."""
    given = docs.sparkSession.sparkContext.broadcast(sample)  # bounded: SAMPLE_TEXTS texts a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(given.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = b.slice(at, 1024)
                langs, score = p.predict(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows that are not held out.  A null doc_id is never learnt from."""
    fold = crc_fold(F.col("doc_id"), FOLDS)
    found = predictions(docs, fit(docs, fold != HELD_OUT))
    return found.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
