"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage (overlapping windows over the whole text of every document) is a query. Impacts are
normalised by an item's score against itself, so one threshold serves items of any length; all items
that reach it are retrieved, and a hit stands if the passage covers enough of the item's question
and of its answer by word n-grams.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classes import row_key
from .util import drop_scratch, free, kept_alone, scratch

K1, B = 1.2, 0.75
BLOCK = 4
THRESHOLD = 0.5
OVERLAP = 0.6
NGRAM = 4
#: Items in one index; a larger benchmark is searched slice by slice, so that what is sent stays bounded.
MAX_ITEMS = 20_000
#: Cells up to which the block maxima are kept as a matrix.
DENSE = 1 << 24
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: all sentences but the last, and the last.

    With one sentence, or a last one of under three words, the last third of the words is the answer.
    """
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if words(p)]
    if len(parts) > 1 and len(words(parts[-1])) >= 3:
        return words(" ".join(parts[:-1])), words(parts[-1])
    w = words(text)
    cut = max(1, len(w) - max(1, len(w) // 3))
    return w[:cut], w[cut:]


def coverage(part: list[str], grams: set[tuple[str, ...]], n: int) -> float:
    """Share of the words of `part` inside an n-gram that the passage has (shorter parts: as one)."""
    n = min(n, len(part))
    if not n:
        return 1.0
    hit = np.zeros(len(part), bool)
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in grams:
            hit[i : i + n] = True
    return float(hit.mean())


class Statistics(NamedTuple):
    """Of all items with words: how many, their words, the longest's words, and items by word."""

    n: int
    total: int
    longest: int
    df: dict[str, int]


class ItemIndex:
    """Postings of normalised impacts, with the maximum of each block of item numbers.

    Items that are a slice of a benchmark need the statistics of all of it.
    """

    def __init__(self, items: list[tuple[int, str]], of_all: Statistics | None = None) -> None:
        items = [(i, t) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0])) if words(t)]
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        bags = [Counter(words(t)) for _, t in items]
        lens = [sum(b.values()) for b in bags]
        of_all = of_all or Statistics(len(items), sum(lens), max(lens, default=1), Counter(t for b in bags for t in b))
        n = of_all.n
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in of_all.df.items()}
        mean = of_all.total / max(1, n)
        self.longest = of_all.longest
        posts: dict[str, list[tuple[int, float]]] = {}
        for k, b in enumerate(bags):
            raw = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * lens[k] / mean)) for t, c in b.items()}
            own = sum(raw.values())
            for t, x in raw.items():
                posts.setdefault(t, []).append((k, x / own))
        self.term = {t: i for i, t in enumerate(posts)}
        self.docs = [np.array([k for k, _ in p], np.int32) for p in posts.values()]
        self.impact = [np.array([x for _, x in p]) for p in posts.values()]
        self.most = np.array([x.max() for x in self.impact] + [0.0])  # the last one: words of no item
        blocks = -(-len(items) // BLOCK)
        self.tops: list[tuple[np.ndarray, np.ndarray]] = []  # by term: the blocks it is in, and its most there
        for d, x in zip(self.docs, self.impact, strict=True):
            at = np.flatnonzero(np.concatenate(([True], d[1:] // BLOCK != d[:-1] // BLOCK)))
            self.tops.append((d[at] // BLOCK, np.maximum.reduceat(x, at)))
        self.n_blocks = blocks
        self.lists: list[dict[int, tuple[list[int], list[float], float]]] = [{} for _ in range(blocks)]  # by block and term
        for t, (d, x) in enumerate(zip(self.docs, self.impact, strict=True)):
            for k, v in zip(d.tolist(), x.tolist(), strict=True):
                items, impacts, top = self.lists[k // BLOCK].get(t, ([], [], 0.0))
                self.lists[k // BLOCK][t] = ([*items, k], [*impacts, v], max(top, v))
        self.dense = np.zeros((len(self.docs) + 1, blocks), np.float32) if (len(self.docs) + 1) * blocks <= DENSE else None
        if self.dense is not None:
            for t, (k, v) in enumerate(self.tops):
                self.dense[t, k] = np.nextafter(v.astype(np.float32), np.float32(2))  # rounded up: a bound

    def live_blocks(self, terms: np.ndarray, least: float) -> np.ndarray:
        """Blocks of items that can reach `least` with these distinct terms, by the sum of their maxima."""
        if self.dense is not None:
            bound = self.dense[terms].sum(axis=0)
        else:
            tops = [self.tops[t] for t in terms if t < len(self.tops)]
            bound = np.bincount(np.concatenate([k for k, _ in tops]), np.concatenate([v for _, v in tops]), self.n_blocks) if tops else np.zeros(self.n_blocks)
        return np.flatnonzero(bound >= least - 1e-5)

    def search(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All items that score at least `least` for these distinct terms: WAND, skipping dead blocks."""
        out: list[tuple[int, float]] = []
        names = terms.tolist()
        for block in self.live_blocks(terms, least).tolist():
            have = self.lists[block].get
            out += self._wand([[i, v, 0, top] for i, v, top in filter(None, map(have, names))], least)
        return out

    @staticmethod
    def _wand(lists: list[list], least: float) -> list[tuple[int, float]]:
        """Document-at-a-time search of one block: the pivot is the first item that the lists' maxima can lift to `least`."""
        out = []
        while True:
            lists = sorted((x for x in lists if x[2] < len(x[0])), key=lambda x: x[0][x[2]])
            total, pivot = 0.0, None
            for x in lists:
                total += x[3]
                if total >= least - 1e-9:
                    pivot = x[0][x[2]]
                    break
            if pivot is None:
                return out
            score = 0.0
            for x in lists:
                while x[2] < len(x[0]) and x[0][x[2]] < pivot:
                    x[2] += 1
                if x[2] < len(x[0]) and x[0][x[2]] == pivot:
                    score += x[1][x[2]]
                    x[2] += 1
            if score >= least - 1e-9:
                out.append((pivot, score))

    def matches(self, text: str, threshold: float, overlap: float, ngram: int) -> dict[int, tuple[float, float, float]]:
        """Item number -> (score, question overlap, answer overlap) of the best verified passage."""
        w = words(text)
        if not w or not self.ids:
            return {}
        none = len(self.term)
        get = self.term.get
        t = np.array([get(x, none) for x in w], dtype=np.int64)
        step = max(16, self.longest)
        out: dict[int, tuple[float, float, float]] = {}
        known = np.flatnonzero(t < none)
        if not len(known):
            return {}
        for lo in range(0, max(1, len(w) - step), step):
            own = np.unique(t[lo : lo + 2 * step])
            if self.most[own].sum() < threshold:
                continue
            found = self.search(own, threshold)
            if not found:
                continue
            passage = w[lo : lo + 2 * step]
            grams: dict[int, set] = {}
            for k, score in found:
                seen = []
                for part in self.parts[k]:
                    n = min(ngram, len(part))
                    if n not in grams:
                        grams[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} if n else set()
                    seen.append(coverage(part, grams[n], ngram))
                if min(seen) >= overlap and score > out.get(k, (0.0, 0.0, 0.0))[0]:
                    out[k] = (score, *seen)
        return out


def _word_counts(items: DataFrame) -> DataFrame:
    """(term, items, n, total, longest): a row of counts by word and batch, and one with a null term for the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bags = [w for w in map(words, rows.column(0).to_pylist()) if w]
            df = Counter(t for w in bags for t in set(w))
            lens = [len(w) for w in bags]
            zeros = [0] * len(df)
            cols = [[*df, None], [*df.values(), 0], [*zeros, len(lens)], [*zeros, sum(lens)], [*zeros, max(lens, default=0)]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["term", "items", "n", "total", "longest"])

    parts = items.select("text").mapInArrow(run, "term string, items long, n long, total long, longest long")
    return parts.groupBy("term").agg(F.sum("items").alias("items"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("longest").alias("longest"))


def _slice_statistics(counts: DataFrame, part: DataFrame) -> Statistics:
    """The statistics of all items, by word for those of the slice only."""
    own = _word_counts(part).select(F.col("term").alias("own"))
    got = counts.join(own, F.col("term").eqNullSafe(F.col("own")), "left_semi").collect()  # as many as the slice has words
    all_ = next(r for r in got if r["term"] is None)
    return Statistics(all_["n"], all_["total"], max(1, all_["longest"]), {r["term"]: r["items"] for r in got if r["term"] is not None})


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, ngram: int = NGRAM, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every verified pair.

    Items without words are never found, null or empty texts have no passages. Rows of docs that
    repeat a doc_id are searched each, and give one row a pair with the best score; a null doc_id is an
    id like others. Of equal scores the greater overlaps are reported. Texts are searched whole, however long.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    slices = max(1, math.ceil(items.count() / max_items))
    counts = None if slices == 1 else scratch(_word_counts(items), "item-words")
    out = None
    for s in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s)
        rows = [(r["item_id"], r["text"]) for r in part.collect()]  # about max_items rows
        if not rows and slices > 1:
            continue
        index = spark.sparkContext.broadcast(ItemIndex(rows, None if slices == 1 else _slice_statistics(counts, part)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for rows in batches:
                found = [(d, ix.ids[k], *x) for d, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for k, x in ix.matches(text, threshold, overlap, ngram).items()]
                cols = list(zip(*found, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        got = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, schema)
        out = got if out is None else out.unionAll(got)
    if counts is not None:
        drop_scratch(counts)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how: object) -> DataFrame:
    """The rows of docs, all columns, that hold no item. Each row goes by its own text, whatever ids others share with it or lack."""
    def leaking() -> DataFrame:
        keyed = row_key(docs).select(F.col("rk").alias("doc_id"), "text")
        return find_leaks(keyed, benchmark, **how).select(F.col("doc_id").alias("leak")).distinct()

    key, leak = free(docs, "row_key", "leak")
    leaks = kept_alone(docs.sparkSession, leaking, "leaks").toDF(leak)
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(leaks, F.col(key) == F.col(leak), "left_anti").select(*docs.columns)
