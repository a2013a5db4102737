"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile lists the most frequent letter 1- to 3-grams (word edges marked) of a language, most
frequent first. A document gets its own list over its whole text; the distance to a profile is the
sum, over the document's n-grams, of how far each is out of place, an absent one counting as the
profile's length. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import drop_caches

PROFILE_SIZE = 400
DOC_GRAMS = 300
UNKNOWN = "und"
#: Bits of a letter within an n-gram's code: room for every code point.
_BITS = np.uint64(21)
#: The same for texts whose letters all lie in the first 1,000 code points.
_NARROW = 10
#: Codes counted at once, so that a task's memory does not follow the batch.
_PIECE = 500_000
_EDGE = 1
_ALPHA: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point -> 0 for what is no letter, else the code point + 2."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((i + 2 if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000)
    return _ALPHA


def _raw_codes(text: str) -> np.ndarray:
    """All 1-, 2- and 3-grams of the lower-cased letters, words padded with an edge mark, in _NARROW bits a letter if these do, else in _BITS."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _letter_table()[cps]
    if not (most := c.max(initial=0)):
        return np.empty(0, dtype=np.uint32)
    kind, bits = (np.uint32, np.uint32(_NARROW)) if most < 1 << _NARROW else (np.uint64, _BITS)
    c = np.concatenate(([0], c, [0])).astype(kind)
    keep = (c[1:] != 0) | (c[:-1] != 0)  # one mark for each run of other characters
    c = c[np.concatenate(([True], keep))]
    edge = c == 0
    c[edge] = _EDGE
    pair = (c[:-1] << bits) | c[1:]
    return np.concatenate((c[~edge], pair[~(edge[:-1] & edge[1:])], ((c[:-2] << (bits + bits)) | pair[1:])[~edge[1:-1]]))


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in _BITS a letter, ascending, and how often each occurs."""
    g, n = np.unique(codes, return_counts=True)
    if g.dtype == np.uint32:
        g, low = g.astype(np.uint64), np.uint64((1 << _NARROW) - 1)
        a, b = np.uint64(2 * _NARROW), np.uint64(_NARROW)
        g = ((g >> a) << (_BITS + _BITS)) | (((g >> b) & low) << _BITS) | (g & low)
    return g, n


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    drop_caches()
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=True):
            held: dict[type, list[np.ndarray]] = {}
            size, seen = 0, []
            for t in [*part["text"], None]:
                if t is not None:
                    codes = _raw_codes(t)
                    held.setdefault(codes.dtype.type, []).append(codes)
                    size += len(codes)
                if size > _PIECE or t is None:
                    seen += [_counted(np.concatenate(x)) for x in held.values()]
                    held, size = {}, 0
            g, i = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
            n = np.bincount(i, np.concatenate([n for _, n in seen]), len(g))
            yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": n.astype(np.int64)})


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank) of the `size` most frequent n-grams of each language, over all given rows.

    Rows whose text or lang is null are left out; ties go to the smaller code.
    """
    grams = (
        docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .mapInPandas(_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    # a limit on the row number itself lets each task cut its groups before the shuffle
    return grams.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("rank"))


def identify(docs: DataFrame, profiles: DataFrame, doc_grams: int = DOC_GRAMS, size: int = PROFILE_SIZE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, lang_pred, score); one row for each row of docs.

    Null or letterless texts give 'und' with score 0; so does an empty set of profiles. Equal
    distances go to the alphabetically first language. The profiles are `size` rows a language, so
    what is sent to the tasks is bounded by the number of languages.
    """
    guess = _guesser(profiles, doc_grams, size)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [guess(t) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: DataFrame, least: float, doc_grams: int = DOC_GRAMS, size: int = PROFILE_SIZE) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of at least `least`."""
    guess, at = _guesser(profiles, doc_grams, size), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [guess(t) for t in rows.column(at).to_pylist()]
            yield rows.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _guesser(profiles: DataFrame, doc_grams: int, size: int) -> Callable[[str | None], tuple[str, float]]:
    """A function of a text that gives its language and score."""
    table = profiles.orderBy("lang", "rank").collect()
    langs = sorted({r["lang"] for r in table})
    known = np.array(sorted({r["gram"] for r in table}), dtype=np.uint64)
    place = np.full((len(langs), len(known) + 1), -1, dtype=np.int32)
    at, row = {g: i for i, g in enumerate(known.tolist())}, {x: i for i, x in enumerate(langs)}
    for r in table:
        place[row[r["lang"]], at[r["gram"]]] = r["rank"]

    def guess(text: str | None) -> tuple[str, float]:
        codes = _raw_codes(text or "")
        if not len(codes) or not langs:
            return UNKNOWN, 0.0
        g, n = _counted(codes)
        top = g[np.argsort(-n, kind="stable")[:doc_grams]]
        i = np.minimum(np.searchsorted(known, top), len(known) - 1)
        p = place[:, np.where(known[i] == top, i, len(known))]
        far = np.where(p < 0, size, np.minimum(np.abs(p - np.arange(len(top))), size)).sum(axis=1)
        best = int(far.argmin())
        return langs[best], 1.0 - float(far[best]) / (size * len(top))

    return guess


def held_out(doc_id: str = "doc_id"):
    """True for the fold that is never learned from: crc32 of the id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
