"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A passage counts as repeated if `length` consecutive words also occur in a document with a smaller
doc_id. Suffixes are sampled at anchors: in each window of `length` words the anchor is the start of
the shortest prefix with the least hash, among the places that leave room for the longest prefix; so
equal windows have equal anchors and share the longest prefix from there. Then

1. prefixes are counted; one that occurs in a single document has no node deep enough and goes;
2. a prefix with more suffixes than a group may hold is split by further words, prefix by prefix,
   until each group fits in memory; only documents with such a prefix are looked at again;
3. each group builds its subtree, as a suffix array with the lengths of common prefixes; the internal
   nodes of depth `length` and more are the repeats, and the windows under a node are marked but for
   those of its least doc_id;
4. what even the longest prefix does not split is one passage in very many documents: it is dealt out to
   several groups, each marks all but its own least document, and what is left, a document a group and
   window, is settled by the node of depth `length`, the window itself;
5. marks become word spans, and the other words are kept.

Documents with the same words are one class, entered once by its least doc_id.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classes import class_texts, find_classes, row_key
from .hashing import gram_hashes, mix64, word_hashes
from .util import scratch

LENGTH = 50
#: Lengths of prefixes, in words: the first is tried first, the others where more suffixes share it than a group holds.
PREFIXES = (8, 16)
#: Suffixes in one group.
GROUP_ROWS = 4000
#: Words that a task puts into one suffix array.
GROUP_WORDS = 1_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def _class(sha: bytes) -> tuple[int, int]:
    """Two independent numbers of a word sequence, from the hash of its words joined by one space."""
    return struct.unpack("<qq", sha[:16])


def _classes(texts: list[str]) -> list[tuple[int, int]]:
    return [_class(hashlib.sha256(b" ".join(t.encode("utf-8", "surrogatepass").split())).digest()) for t in texts]


def anchors(words: np.ndarray, length: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each anchor; a window is named by its first word."""
    grams = gram_hashes(words, prefixes[0])[: max(len(words) - prefixes[-1] + 1, 0)]
    span = length - prefixes[-1] + 1
    if len(grams) < span:
        e = np.empty(0, np.int64)
        return e, e, e
    # leftmost minimum of each span, by blocks: the view is not copied
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = np.concatenate([views[i : i + 65536].argmin(axis=1) for i in range(0, len(views), 65536)]) + np.arange(len(views))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.concatenate((first[1:], [len(at)])) - 1


def heads(words: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n words from each place."""
    return gram_hashes(words, n)[places].view(np.int64)


def _index(docs: DataFrame, length: int, prefixes: tuple[int, ...]) -> DataFrame:
    """(doc_id, rk, n_words, h, chk, sha, heads, times): the anchors' first prefixes and how often each occurs, null where the task already gave that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column(1).to_pylist()]
            sha = [hashlib.sha256(b" ".join(t.split())).digest() for t in raw]
            ns, classes, first, times = [], [], [], []
            for d, x, w in zip(rows.column(0).to_pylist(), sha, word_hashes(raw), strict=True):
                c = _class(x)
                ns.append(len(w))
                classes.append(c)
                if len(w) < length or d is None or c in seen:
                    first.append(None)
                    times.append(None)
                    continue
                seen.add(c)
                h, n = np.unique(heads(w, anchors(w, length, prefixes)[0], prefixes[0]), return_counts=True)
                first.append(h)
                times.append(n.astype(np.int64))
            h, chk = zip(*classes, strict=True) if classes else ((), ())
            cols = [rows.column(0), rows.column(2), pa.array(ns, pa.int64()), pa.array(h, pa.int64()), pa.array(chk, pa.int64()), pa.array([x.hex() for x in sha], pa.string()), pa.array(first, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rk", "n_words", "h", "chk", "sha", "heads", "times"])

    return row_key(docs).mapInArrow(run, "doc_id long, rk long, n_words long, h long, chk long, sha string, heads array<long>, times array<long>")


def _longer(length: int, prefixes: tuple[int, ...], level: int):
    """Documents with their crowded prefixes of one level -> the prefixes of the next level that these split into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            out: dict[str, list] = {"cls": [], "head": [], "times": []}
            for cls, crowded, w in zip(pdf["cls"], pdf["heads"], word_hashes([unpack.decompress(z) for z in pdf["z"]]), strict=True):
                at = anchors(w, length, prefixes)[0]
                at = at[np.isin(heads(w, at, prefixes[level]), crowded)]
                h, n = np.unique(heads(w, at, prefixes[level + 1]), return_counts=True)
                for k, v in zip(out, ([cls] * len(h), h.tolist(), n.tolist()), strict=True):
                    out[k] += v
            yield pd.DataFrame(out)

    return run


def _suffixes(length: int, prefixes: tuple[int, ...]):
    """Candidate documents -> for each anchor with a shared prefix, the words that its windows need.

    Anchors of a document with the same words are one row with all their places.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            out: dict[str, list] = {k: [] for k in ("head", "salt", "salts", "cls", "rep", "at", "n", "ctx")}  # at: all places
            raw = [unpack.decompress(z) for z in pdf["z"]]
            for cls, rep, levels, dealt, salts, w in zip(pdf["cls"], pdf["rep"], pdf["levels"], pdf["heads"], pdf["salts"], word_hashes(raw), strict=True):
                at, lo, hi = anchors(w, length, prefixes)
                deal, share = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # the group's prefix, and how many groups it has
                for level, n in enumerate(prefixes):
                    mine = np.flatnonzero(levels == level)
                    if len(mine):
                        mine = mine[np.argsort(dealt[mine])]
                        h = heads(w, at, n)
                        i = mine[np.minimum(np.searchsorted(dealt[mine], h), len(mine) - 1)]
                        found = (share == 0) & (dealt[i] == h)
                        deal[found], share[found] = h[found], salts[i[found]]
                k = np.flatnonzero(share)
                words = w.tobytes()
                head, first = deal[k].tolist(), lo[k].tolist()
                ctx = [words[8 * a : 8 * (b + length)] for a, b in zip(first, hi[k].tolist(), strict=True)]
                places: dict[tuple[int, bytes], list[int]] = {}
                for x, c, a in zip(head, ctx, first, strict=True):
                    places.setdefault((x, c), []).append(a)
                of = dict(zip(head, share[k].tolist(), strict=True))
                own = zlib.crc32(b"%d" % cls)
                rows = len(places)
                out["head"] += [x for x, _ in places]
                out["salts"] += [of[x] for x, _ in places]
                out["salt"] += [(own + a[0]) % of[x] for (x, _), a in places.items()]
                out["cls"] += [cls] * rows
                out["rep"] += [rep] * rows
                out["at"] += places.values()
                out["n"] += [len(c) // 8 - length + 1 for _, c in places]
                out["ctx"] += [c for _, c in places]
            yield pd.DataFrame(out)

    return run


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the starts in the order of their next `depth` words, and how many of these each shares with the one before it.

    Words are named by their first 1, 2, 4, ... words (prefix doubling); the names give both the order and,
    from the longest to the shortest, the common prefixes.
    """
    names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while 2 << (len(names) - 1) <= depth:
        have = 1 << (len(names) - 1)
        names.append(_names(names[-1][:-have], names[-1][have:]))
    have = 1 << (len(names) - 1)
    order = np.argsort(_names(names[-1][starts], names[-1][starts + depth - have]), kind="stable")
    x, y = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(max(len(order) - 1, 0), np.int64)
    alive = np.ones(len(common), bool)
    done = 0
    while done < depth and len(common):  # greedy: as long steps as fit into what is left
        step = min(len(names) - 1, (depth - done).bit_length() - 1)
        same = alive & (names[step][x + done] == names[step][y + done])
        common[same] += 1 << step
        for k in range(step - 1, -1, -1):  # those that end here: by shorter steps
            ends = alive & ~same
            at = common[ends]
            more = names[k][x[ends] + at] == names[k][y[ends] + at]
            common[np.flatnonzero(ends)[more]] += 1 << k
        alive &= same
        done += 1 << step
    return order, np.concatenate((np.zeros(min(len(order), 1), np.int64), common))


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each start the internal node of that depth or more it hangs under, the leaves of a node by one number."""
    order, common = suffix_array(words, starts, depth)
    node = np.empty(len(starts), np.int64)
    node[order] = np.cumsum(common < depth) - 1
    return node


def _trees(length: int):
    """Suffix groups -> marked windows (kind 0: cls, first, last) and windows left open (kind 1: key, low, cls, rep, all places in cls)."""

    def build(rows: list[pd.DataFrame]) -> pd.DataFrame | None:
        g = pd.concat(rows, ignore_index=True)
        words = np.frombuffer(b"".join(g["ctx"]), np.uint64)
        size = g["ctx"].str.len().to_numpy() // 8
        n = g["n"].to_numpy()
        row = np.repeat(np.arange(len(g)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(np.cumsum(size) - size, n) + offset
        node = deep_nodes(words, starts, length)
        # groups of one prefix are apart by content; those of one prefix dealt out must be told apart by their salt
        salt = g["salt"].to_numpy()[row].astype(np.int64)
        node = _names(node, salt) if salt.any() else node
        rep, cls = g["rep"].to_numpy()[row], g["cls"].to_numpy()[row]
        flat, many = np.concatenate(g["at"].to_numpy()).astype(np.int64), g["at"].str.len().to_numpy()
        begin = np.cumsum(many) - many

        def places(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """All places of the chosen windows, and which window each is of."""
            k = np.flatnonzero(chosen)
            n = many[row[k]]
            at = np.arange(n.sum()) + np.repeat(begin[row[k]] - np.cumsum(n) + n, n)
            k = np.repeat(k, n)
            return flat[at] + offset[k], k

        least = np.full(int(node.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, rep)
        marked = rep > least[node]
        p, k = places(marked)
        c = cls[k]
        order = np.lexsort((p, c))
        c, p = c[order], p[order]
        head = np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] > p[:-1] + 1))) if len(c) else np.empty(0, bool)
        first, last = np.flatnonzero(head), np.concatenate((np.flatnonzero(head)[1:] - 1, [len(c) - 1])) if len(c) else np.empty(0, np.int64)
        k = np.flatnonzero(~marked & (g["salts"].to_numpy()[row] > 1))
        s = starts[k]
        key = np.empty((2, len(s)), np.uint64)
        for i in range(0, len(s), 50_000):  # the node itself: all words of the window
            w = words[s[i : i + 50_000, None] + np.arange(length)]
            key[0, i : i + 50_000], key[1, i : i + 50_000] = gram_hashes_rows(w), gram_hashes_rows(w, 0xD1B54A32D192ED03)
        none = np.zeros(len(first), np.int64)
        own = [flat[begin[r] : begin[r] + many[r]] + o for r, o in zip(row[k].tolist(), offset[k].tolist(), strict=True)]
        return pd.DataFrame({
            "kind": np.repeat([0, 1], [len(first), len(s)]).astype(np.int32), "cls": np.concatenate((c[first], cls[k])), "rep": np.concatenate((none, rep[k])),
            "first": np.concatenate((p[first], np.zeros(len(s), np.int64))).astype(np.int32), "last": np.concatenate((p[last], np.zeros(len(s), np.int64))).astype(np.int32),
            "key": np.concatenate((none, key[0].view(np.int64))), "low": np.concatenate((none, key[1].view(np.int64))), "places": pd.Series([None] * len(first) + own, dtype=object),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[["head", "salt"]].to_numpy()
            words = np.cumsum(pdf["ctx"].str.len().to_numpy() // 8)
            new = np.flatnonzero(np.concatenate(([last is None or bool((key[0] != last).any())], (key[1:] != key[:-1]).any(axis=1))))
            lo = 0
            for cut in new:  # only between groups
                if size + words[cut - 1] * (cut > 0) - (words[lo - 1] if lo else 0) >= GROUP_WORDS:
                    if cut > lo:
                        held.append(pdf.iloc[lo:cut])
                    yield build(held)
                    held, size, lo = [], 0, cut
            if lo < len(pdf):
                held.append(pdf.iloc[lo:])
                size += int(words[-1] - (words[lo - 1] if lo else 0))
            last = key[-1]
        if held:
            yield build(held)

    return run


def gram_hashes_rows(w: np.ndarray, step: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One hash for each row of words."""
    out = w[:, 0].copy()
    for k in range(1, w.shape[1]):
        out = out * np.uint64(step) + w[:, k]
    return mix64(out)


def _cut(length: int):
    """Texts with their marked windows -> what is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for cls, z, first, last in zip(pdf["cls"], pdf["z"], pdf["first"], pdf["last"], strict=True):
                words = unpack.decompress(z).split()
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, np.asarray(first), 1)
                np.add.at(delta, np.asarray(last) + length, -1)
                gone = np.cumsum(delta)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = b" ".join(w for w, x in zip(words, gone, strict=True) if not x)
                out.append((cls, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)], kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["k", "removed", "cut_sha", "spans", "kept"])

    return run


def _counted(entries: DataFrame) -> DataFrame:
    """entries(cls, head, times) -> (head, c) of the prefixes that occur in two classes or more. A class may be entered by several tasks: it is one document still."""
    per = entries.groupBy("head").agg(F.sum("times").alias("c"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    return scratch(per.where("lo <> hi").select("head", "c"), "prefixes")


def dedup(docs: DataFrame, length: int = LENGTH, prefixes: tuple[int, ...] = PREFIXES, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256, spans), one row for each row of docs.

    spans are the removed words as [start, end). Null and empty texts have no words. Rows that share
    a doc_id do not remove each other's words; a null doc_id is in no order, so nothing is removed
    from such a row nor because of it. with_text adds kept_text of the documents that were cut.
    `prefixes` rise and the last is at most `length`.
    """
    index = scratch(_index(docs, length, prefixes), "words")
    index, reps, clashes = find_classes(index, f"n_words >= {length} AND doc_id IS NOT NULL")
    entries = index.where(F.col("heads").isNotNull()).select("cls", F.explode(F.arrays_zip("heads", "times")).alias("x")).select("cls", F.col("x.heads").alias("head"), F.col("x.times").alias("times"))
    shared = _counted(entries)
    mine = scratch(entries.join(shared, "head").select("cls", "head", "c").distinct(), "candidates")
    texts = scratch(class_texts(docs, mine.select("cls").distinct(), reps, clashes, _classes), "texts")
    dealt = []
    for level in range(len(prefixes)):
        fits = mine.where(F.col("c") <= GROUP_ROWS)
        dealt.append(fits.select("cls", F.lit(level).alias("level"), "head", F.lit(1).alias("salts")))
        crowded = mine.where(F.col("c") > GROUP_ROWS)
        if level == len(prefixes) - 1:
            dealt.append(crowded.select("cls", F.lit(level).alias("level"), "head", F.ceil(F.col("c") / GROUP_ROWS).cast("int").alias("salts")))
        elif crowded.isEmpty():
            break
        else:
            some = crowded.groupBy("cls").agg(F.collect_list("head").alias("heads")).join(texts, "cls")
            entries = scratch(some.select("cls", "heads", "z").mapInPandas(_longer(length, prefixes, level), "cls long, head long, times long"), "longer")
            mine = scratch(entries.join(_counted(entries), "head").select("cls", "head", "c"), "crowded")
    lists = functools.reduce(DataFrame.unionAll, dealt).groupBy("cls").agg(F.collect_list(F.struct("level", "head", "salts")).alias("x"))  # a document's own anchors
    lists = lists.join(reps.select("cls", "rep"), "cls").join(texts, "cls").select("cls", "rep", F.col("x.level").alias("levels"), F.col("x.head").alias("heads"), F.col("x.salts").alias("salts"), "z")
    suffixes = lists.mapInPandas(_suffixes(length, prefixes), "head long, salt long, salts int, cls long, rep long, at array<int>, n int, ctx binary")
    groups = suffixes.repartition("head", "salt").sortWithinPartitions("head", "salt")
    found = scratch(groups.mapInPandas(_trees(length), "kind int, cls long, rep long, first int, last int, key long, low long, places array<int>"), "marks")

    left = found.where("kind = 1").select("key", "low", "cls", "rep", "places")
    least = left.groupBy("key", "low").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").drop("most")
    late = left.join(least, ["key", "low"]).where("rep > least").select("cls", F.explode("places").alias("first")).select("cls", "first", F.col("first").alias("last"))
    marks = found.where("kind = 0").select("cls", "first", "last").unionAll(late)
    marks = marks.groupBy("cls").agg(F.collect_list(F.struct("first", "last")).alias("m")).select("cls", F.col("m.first").alias("first"), F.col("m.last").alias("last"))
    cut = marks.join(texts, "cls").mapInPandas(_cut(length), "k long, removed long, cut_sha string, spans array<struct<start:int,end:int>>, kept string")
    if not with_text:
        cut = cut.drop("kept")

    out = index.drop("heads", "times").join(reps.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c"), "left").drop("c")
    out = out.join(cut, F.col("cls") == F.col("k"), "left")
    copy = F.col("doc_id") > F.col("rep")  # a later document of the same words loses all of them
    own = F.col("doc_id").isNotNull() & F.col("k").isNotNull()
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).when(own, F.col("cut_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, all_words).when(own, F.col("spans")).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        *([F.when(copy, F.lit("")).when(own, F.col("kept")).alias("kept_text")] if with_text else []),
    )
