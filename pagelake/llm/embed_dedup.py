"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Vectors are projected on many directions and sorted along each. Two vectors collide on a projection if
one lies in the window of set width around the other, so one pass along the sorted order gives the
collisions of a projection; they are counted per pair, and pairs that collide often enough are verified
by their exact cosine. The number asked for is calibrated on pairs just at the threshold.

Windows wide enough to hold near pairs hold a fixed share of all pairs too, so counting over the whole
input would be its square. Therefore the sorted orders of further projections are cut at their medians:
a table is the cells that some of these cuts make, as many cuts as leave a cell a set number of vectors
on average, and vectors meet in the cells of several tables. The share of near pairs that one table
keeps together is measured on a sample with partners just at the threshold; the number of tables
follows from it. Twice the vectors take one cut more and some more tables: for near pairs at a cosine of
0.95 the work grows with the power 1.15 of the input. A cell of more vectors than a task takes is cut in
blocks that all meet each other, so nothing is lost where vectors crowd. A pair that shares several
tables counts in the first of them. Equal vectors are one entry; of links only their number and a
spanning forest leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import scratch

THRESHOLD = 0.95
#: Vectors that a cell holds on average, and the most of one block.
CELL_ROWS, BLOCK_ROWS = 128, 1024
#: Projections on which collisions are counted, and the window in standard deviations of a pair at the threshold.
COUNTED, WINDOW = 24, 1.2
#: Share of pairs at the threshold that share a cell of some table, and of these that collide often enough.
TOGETHER, ENOUGH = 0.985, 0.99
#: Tables and cuts of a table, at most.
TABLES, CUTS = 64, 40
#: Vectors of the sample from which medians and shares are taken, and the most numbers it may hold.
SAMPLE, SAMPLE_CELLS = 4000, 4_000_000
_SEED = 7


@lru_cache(maxsize=16)
def directions(dim: int, n: int, seed: int = _SEED) -> np.ndarray:
    a = np.random.RandomState(seed).standard_normal((dim, n))
    return a / np.linalg.norm(a, axis=0)


def window(dim: int, threshold: float) -> float:
    return WINDOW * np.sqrt(2 - 2 * threshold) / np.sqrt(dim)


def partners(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector another one at just the threshold, in a random direction."""
    y = np.random.RandomState(_SEED + 1).standard_normal(x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    return threshold * x + np.sqrt(1 - threshold**2) * y


def collisions_asked(x: np.ndarray, threshold: float, enough: float = ENOUGH) -> int:
    """Collisions to ask for, so that the share `enough` of pairs at the threshold has as many."""
    dim = x.shape[1]
    if dim == 1:
        return 0
    hits = (np.abs((x - partners(x, threshold)) @ directions(dim, COUNTED)) <= window(dim, threshold)).sum(axis=1)
    return int(np.quantile(hits, 1 - enough, method="lower"))


def plan_tables(x: np.ndarray, n: int, threshold: float, cell_rows: int = CELL_ROWS, together: float = TOGETHER) -> list[tuple[np.ndarray, np.ndarray]]:
    """(directions, medians) of each table for n vectors of which x is a sample of unit vectors.

    Tables are added until the share `together` of the sample's pairs at the threshold shares a cell of one. Where
    TABLES do not reach it, the cells are made larger by leaving out a cut, down to one cell for all: the share holds at any n.
    """
    dim = x.shape[1]
    cuts = min(max(math.ceil(math.log2(max(n / cell_rows, 1))), 0), CUTS)
    y = partners(x, threshold)
    while cuts and dim > 1:
        met, tables = np.zeros(len(x), bool), []
        while len(tables) < TABLES and met.mean() < together:
            a = directions(dim, cuts, _SEED + 100 + len(tables))
            p = x @ a
            at = np.median(p, axis=0)
            met |= ((p >= at) == (y @ a >= at)).all(axis=1)
            tables.append((a, at))
        if met.mean() >= together:
            return tables
        cuts -= 1  # so many tables do not do with cells as small as these
    return [(np.empty((dim, 0)), np.empty(0))]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codes(v: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The cell of each unit vector in each table."""
    if not tables:
        return np.empty((len(v), 0), np.int64)
    return np.stack([((v @ a >= at) @ (1 << np.arange(len(at), dtype=np.int64))).astype(np.int64) for a, at in tables], axis=1)


def _doubles(packed: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of packed ones, which are singles where these hold the value exactly."""
    out = np.empty((len(packed), dim))
    size = np.array([len(x) for x in packed])
    for n, kind in ((4 * dim, np.float32), (8 * dim, np.float64)):
        k = np.flatnonzero(size == n)
        if len(k):
            out[k] = np.frombuffer(b"".join(packed[i] for i in k.tolist()), kind).reshape(len(k), dim)
    return _unit(out)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, v): the vector's bytes, null if it is null, zero, or holds what is no finite number."""
    for b in batches:
        dims, out = [], []
        for v in b.column(1):
            x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            norm = np.sqrt((x * x).sum()) if x is not None and len(x) and np.isfinite(x).all() else 0.0
            if not np.isfinite(norm) or norm == 0:  # scaled first, as squares may leave the range of doubles
                big = np.abs(x).max() if x is not None and len(x) and np.isfinite(x).all() else 0.0
                x = x / big if big > 0 else None
                norm = np.sqrt((x * x).sum()) if x is not None else 0.0
            ok = norm > 0
            dims.append(len(x) if ok else 0)
            with np.errstate(over="ignore", under="ignore"):
                single = x.astype(np.float32) if ok else None
            out.append(None if not ok else single.tobytes() if (single == x).all() else x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def collide(p: np.ndarray, q: np.ndarray | None, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of p, j of q; q None: i < j of p) that lie within a window of each other on `least` projections or more.

    Each projection is sorted; the window around each place is a run of the sorted order.
    """
    own = q is None
    other = p if own else q
    hits = np.zeros((len(p), len(other)), np.uint8)
    for k in range(p.shape[1]):
        order = np.argsort(other[:, k], kind="stable")
        line = other[order, k]
        lo, hi = np.searchsorted(line, p[:, k] - width, "left"), np.searchsorted(line, p[:, k] + width, "right")
        # a window begins where +1 is put and ends where -1 is put: the running sum along the order marks it
        marks = np.zeros((len(p), len(other) + 1), np.int8)
        rows = np.arange(len(p))
        marks[rows, lo] += 1
        marks[rows, hi] -= 1
        hits[:, order] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8).view(np.uint8)
    near = hits >= least
    return np.nonzero(np.triu(near, 1) if own else near)


def _cells(dim: int, threshold: float, least: int, shared: Broadcast):
    """Vectors of a cell, or of two blocks of one (side 0 and 1) -> number of links and a root for those linked."""
    a, width = directions(dim, COUNTED), window(dim, threshold)

    def links(v: np.ndarray, code: np.ndarray, table: int, cut: int | None) -> tuple[np.ndarray, np.ndarray]:
        p = v @ a
        i, j = collide(p if cut is None else p[:cut], None if cut is None else p[cut:], width, least)
        j = j if cut is None else j + cut
        if table:
            first = ~(code[i, :table] == code[j, :table]).any(axis=1)
            i, j = i[first], j[first]
        ok = [np.einsum("ij,ij->i", v[i[s : s + 100_000]], v[j[s : s + 100_000]]) >= threshold for s in range(0, len(i), 100_000)]
        ok = np.concatenate(ok) if ok else np.empty(0, bool)
        return i[ok], j[ok]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches):
            v = _doubles(pdf["v"].tolist(), dim)
            code = codes(v, shared.value[: int(pdf["t"].iloc[-1])])  # of the tables before the last one here
            side, rep, copies = pdf["side"].to_numpy(), pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
            key = pdf[_KEY].to_numpy()
            ends = np.concatenate((np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(pdf)]))
            out_i, out_j, lo = [], [], 0
            for hi in ends.tolist():
                cut = int((side[lo:hi] == 0).sum())
                if hi - lo > 1 and (cut == hi - lo) == (key[lo, 2] == key[lo, 3]):
                    i, j = links(v[lo:hi], code[lo:hi], int(key[lo, 0]), None if cut == hi - lo else cut)
                    out_i.append(i + lo)
                    out_j.append(j + lo)
                lo = hi
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_i, out_j))
            n = np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
            root = _roots(len(pdf), i, j)
            k = np.flatnonzero(n > 0)
            yield pd.DataFrame({"rep": rep[k], "h": pdf["h"].to_numpy()[k], "links": n[k].astype(np.int64), "root": rep[root[k]]})

    return run


_KEY = ["t", "cell", "b1", "b2"]


def _groups(batches: Iterator[pd.DataFrame], rows: int = 8192) -> Iterator[pd.DataFrame]:
    """Pieces of a sorted partition that end where a key ends."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[_KEY].to_numpy()
        new = np.flatnonzero(np.concatenate(([bool(held) and (held[-1][_KEY].to_numpy()[-1] != key[0]).any()], (key[1:] != key[:-1]).any(axis=1))))
        lo = 0
        for cut in new.tolist():
            if size + cut - lo >= rows:
                if cut > lo:
                    held.append(pdf.iloc[lo:cut])
                yield pd.concat(held, ignore_index=True)
                held, size, lo = [], 0, cut
        held.append(pdf.iloc[lo:])
        size += len(pdf) - lo
    if held:
        yield pd.concat(held, ignore_index=True)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept), one row for each row.

    n_links: other vectors found with cosine >= threshold in double precision, none below it; some
    pairs near the threshold may be missed (TOGETHER, ENOUGH). Null or zero vectors, and those with
    null or non-finite components, link with nothing; so do vectors of different lengths, and rows
    without a vec_id (their component is null). Rows that share a vec_id are separate vectors and one node.
    """
    packed = scratch(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).mapInArrow(_pack, "vec_id long, dim int, v binary"), "vectors")
    classes = packed.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).groupBy("dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("h", F.xxhash64("v"))  # tells vectors of one vec_id apart
    classes = scratch(classes, "classes")
    found: DataFrame | None = None
    for r in classes.groupBy("dim").count().collect():  # one row for each length of vectors
        part = _search(classes.where(F.col("dim") == r["dim"]), r["dim"], r["count"], threshold, cell_rows, block_rows)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "rep long, h long, links long, root long")
    found = scratch(found, "found")
    links = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, ["rep", "h"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = packed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("v")).alias("v")).join(named, F.col("v") == F.col("w"), "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def _search(own: DataFrame, dim: int, n: int, threshold: float, cell_rows: int, block_rows: int) -> DataFrame:
    few = own.select("v").orderBy(F.xxhash64("v")).limit(min(SAMPLE, max(SAMPLE_CELLS // dim, 100))).collect()  # bounded: SAMPLE_CELLS numbers
    x = _doubles([bytes(r["v"]) for r in few], dim)
    tables = plan_tables(x, n, threshold, cell_rows)
    least = collisions_asked(x, threshold)
    shared = own.sparkSession.sparkContext.broadcast(tables)  # TABLES * CUTS directions at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codes(_doubles(b.column(2).to_pylist(), dim), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(c), pa.list_(pa.int64()))], names=["rep", "copies", "v", "h", "cells"])

    rows = own.select("rep", "copies", "v", "h").mapInArrow(coded, "rep long, copies long, v binary, h long, cells array<long>")
    rows = scratch(rows, "coded")
    each = rows.select(F.posexplode("cells").alias("t", "cell"))
    # cells with two vectors or more; those with more than a block are cut
    cells = each.groupBy("t", "cell").agg(F.count("*").alias("c")).where("c > 1").select("t", "cell", F.ceil(F.col("c") / block_rows).cast("int").alias("blocks"))
    cells = scratch(cells, "cells")
    if cells.where("blocks > 1").isEmpty():
        tiles = rows.select("rep", "h", "copies", "v", F.posexplode("cells").alias("t", "cell")).select(*_FIELDS, F.lit(0).alias("b1"), F.lit(0).alias("b2"), F.lit(0).alias("side"))
    else:
        tiles = rows.select("rep", "h", "copies", "v", F.posexplode("cells").alias("t", "cell")).join(cells, ["t", "cell"])
        tiles = tiles.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = tiles.select(*_FIELDS, F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"))
    tiles = tiles.repartition(*_KEY).sortWithinPartitions(*_KEY, "side")
    return tiles.mapInPandas(_cells(dim, threshold, least, shared), "rep long, h long, links long, root long")


_FIELDS = ["t", "cell", "rep", "h", "copies", "v"]
