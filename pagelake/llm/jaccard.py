"""Exact n-gram Jaccard join with set-relation skipping.

Sets are shingles in one global order: rare first, tokens known as frequent last. Two sets that
reach the threshold share a token among the first |s| - ceil(t|s|) + 1 of each (prefix filter), so
an inverted index over those prefixes finds all pairs.

Skipping in the index: an entry carries the set's size and the token's position; a list is ordered
by size and cut into blocks, and blocks whose sizes or positions rule out the needed overlap are
passed over whole.

Skipping of answers: sets that are equal are one class. In a long list every set is first compared
with a few leaders of like size only. A set found highly similar takes over its leader's component, and
of the list only pairs between different components are still open. Their answers are derived from the
leaders' computed ones: a set m meets x in at most as many tokens as its leader does, and |m - leader|
more. What these bounds leave open is bounded by signatures. Of what is left each set first asks for its
nearest few, which are verified by the whole sets; as they mostly make one component of a group, few of
its other pairs are still open in the next round, which asks for more in the lists that had others, until none was left out.
Components, sizes and membership are exact.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .classes import class_texts, find_classes, row_key
from .components import components
from .hashing import gram_hashes, word_hashes
from .util import drop_caches, drop_scratch, free, kept_alone, marked, scratch

SHINGLE = 5
THRESHOLD = 80  # per cent
#: Lists up to this length give all their pairs, longer ones go by leaders first.
SHORT = 6
#: Leaders of a long list, in each range of sizes.
LEADERS = 4
#: Tokens ordered last as frequent: so many at most. Any choice gives the same result.
FREQUENT = 1 << 18
#: Tokens that a task holds at once when it looks for repeated ones.
REPEATS = 1_500_000
#: Entries of one list that one task takes.
LIST_ROWS = 20_000
TILE_ROWS = 4096
_GRAIN = 1024
#: Bits of a set's signature, the parity of its tokens by hash: a power of two near the set's size, within these bounds.
#: Signatures differ in no more bits than sets in tokens.
SIGNATURE = (512, 1 << 17)
#: Bits that the signatures of a list's entries are folded to.
FOLDED = 512
#: Pairs that a set of a long list asks for at first, the nearest by signature, and how many times more from round to round.
NEAREST, FURTHER = 2, 16


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted; with fewer words than n the whole sequence is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words))))


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for w in word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]):  # bytes.lower() is A-Z only
        yield shingle_set(w)


def _hashes(s: np.ndarray) -> tuple[int, int]:
    """Two independent numbers of a set: sets that agree in both are taken as equal."""
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest()) if len(s) else (0, 0)


def signature(s: np.ndarray) -> bytes:
    bits = min(max(1 << max(len(s) - 1, 0).bit_length(), SIGNATURE[0]), SIGNATURE[1])
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(sig: bytes, size: int) -> bytes:
    """A signature brought down to `size` bytes, each half added to the other."""
    while len(sig) > size:
        half = len(sig) // 2
        sig = (int.from_bytes(sig[:half], "little") ^ int.from_bytes(sig[half:], "little")).to_bytes(half, "little")
    return sig


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two signatures differ: at most as many as their sets differ in tokens."""
    size = min(len(a), len(b))
    return (int.from_bytes(fold(a, size), "little") ^ int.from_bytes(fold(b, size), "little")).bit_count()


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def _repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens that occur in two or more sets of this task. One in more sets than there are tasks is always among some task's."""
    drop_caches()
    held, size, seen = [], 0, set()

    def flush() -> pd.DataFrame:
        t, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"token": t[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})

    for pdf in batches:
        for s in _sets(pdf["text"].tolist()):
            if (c := _hashes(s)) in seen:
                continue
            seen.add(c)
            held.append(s)
            size += len(s)
            if size > REPEATS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def frequent_tokens(docs: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts) of the most frequent tokens, rarest first; `most` at most."""
    count = scratch(docs.select("text").where(F.col("text").isNotNull()).mapInPandas(_repeats, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "repeats")
    level = F.floor(F.log2(F.col("n")) * 8).cast("int")
    levels = count.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).orderBy(F.desc("level")).collect()  # some hundred rows
    cut, total = None, 0
    for r in levels:
        total += r["tokens"]
        if total > most and cut is not None:
            break
        cut = r["level"]
    if cut is None or not most:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    got = count.where(level >= cut)
    if total > most and cut == levels[0]["level"]:  # one level alone is too many
        got = got.orderBy(F.desc("n"), "token").limit(most)
    got = got.toPandas()  # `most` rows at most
    drop_scratch(count)
    got = got.sort_values(["n", "token"])
    return got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)


def _index(docs: DataFrame, frequent: np.ndarray, threshold: int) -> DataFrame:
    """(doc_id, rk, n, h, chk, prefix, sig): the prefix in global order and the signature; null where the task already gave that class."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # FREQUENT rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        seen: set[tuple[int, int]] = set()
        for rows in batches:
            ns, classes, heads, sigs = [], [], [], []
            for s in _sets(rows.column(1).to_pylist()):
                c = _hashes(s)
                ns.append(len(s))
                classes.append(c)
                if not len(s) or c in seen:
                    heads.append(None)
                    sigs.append(None)
                    continue
                seen.add(c)
                sigs.append(signature(s))
                p = prefix_length(len(s), threshold)
                if len(known):
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    last = known[i] == s
                    late = s[last]
                    late = late[np.argsort(rank[i[last]])]
                    s = np.concatenate((s[~last], late))
                heads.append(s[:p].view(np.int64))
            h, chk = zip(*classes, strict=True) if classes else ((), ())
            cols = [rows.column(0), rows.column(2), pa.array(ns, pa.int64()), pa.array(h, pa.int64()), pa.array(chk, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rk", "n", "h", "chk", "prefix", "sig"])

    return row_key(docs).mapInArrow(run, "doc_id long, rk long, n long, h long, chk long, prefix array<long>, sig binary")


def _fits(n1, p1, n2, p2, t: int):
    """Whether two entries of a list can still reach the threshold, if this is their first common token."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * small >= t * large) & ((100 + t) * np.minimum(n1 - p1, n2 - p2) >= t * (n1 + n2))


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Pieces of a sorted partition that end where a key ends."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        starts_new = held and (held[-1][keys].to_numpy()[-1] != k[0]).any()
        if starts_new and rows > 50_000:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
        if len(cut) and rows + cut[-1] + 1 > 50_000:
            held.append(pdf.iloc[: cut[-1] + 1])
            yield pd.concat(held, ignore_index=True)
            held, rows = [pdf.iloc[cut[-1] + 1 :]], len(pdf) - cut[-1] - 1
        else:
            held.append(pdf)
            rows += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _leaders(threshold: int):
    """Sorted index entries -> candidate pairs (kind 0: a, b) and the entries of long lists (kind 1: a = token, b = class, n, pos, leads).

    leads are the leaders of the entry's range of sizes, of which the entry itself may be one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, ["token", "salt"]):
            token, salt, cls, n, pos = (pdf[c].to_numpy() for c in ("token", "salt", "cls", "n", "pos"))
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            keep = np.concatenate(([True], ~(same & (cls[1:] == cls[:-1]))))  # a class once a list
            token, salt, cls, n, pos = token[keep], salt[keep], cls[keep], n[keep], pos[keep]
            head = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))))
            size = np.diff(np.concatenate((head, [len(token)])))
            whole = salt[head] == 0  # a dealt-out list counts as long, however few of its entries are here
            a, b, long, leads = [], [], [], []
            for length in range(2, SHORT + 1):
                at = head[whole & (size == length)]
                for i in range(length):
                    for j in range(i + 1, length):
                        x, y = at + i, at + j
                        ok = _fits(n[x], pos[x], n[y], pos[y], threshold)
                        a.append(cls[x[ok]])
                        b.append(cls[y[ok]])
            far = (size > SHORT) | ~whole
            for lo, length in zip(head[far], size[far], strict=True):
                hi, at = lo + length, lo
                long.append(np.arange(lo, hi))
                while at < hi:  # leaders for each range of sizes that can be linked; by class, so lists agree on them
                    end = lo + int(np.searchsorted(n[lo:hi], n[at] * 100 // threshold, "right"))
                    own = np.arange(at, end)
                    chosen = own[np.argsort(cls[at:end])[:LEADERS]]
                    leads.extend([cls[chosen]] * (end - at))
                    for k, lead in enumerate(chosen):
                        y = own[~np.isin(own, chosen[: k + 1])]
                        y = y[_fits(n[lead], pos[lead], n[y], pos[y], threshold)]
                        a.append(np.full(len(y), cls[lead]))
                        b.append(cls[y])
                    at = max(end, at + 1)
            first, second = _unique_pairs(a, b)
            k = np.concatenate(long) if long else np.empty(0, np.int64)
            none = np.zeros(len(first), np.int64)
            yield pd.DataFrame({
                "kind": np.repeat([0, 1], [len(first), len(k)]).astype(np.int32), "a": np.concatenate((first, token[k])), "b": np.concatenate((second, cls[k])),
                "n": np.concatenate((none, n[k])), "pos": np.concatenate((none, pos[k])), "leads": pd.Series([None] * len(first) + leads, dtype=object),
            })

    return run


def _bounds(leads: list[np.ndarray], known: list[np.ndarray], sure: list[np.ndarray], n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each leader: (most tokens that each set shares with it, most tokens of each set that it lacks); infinite where unknown."""
    out = {}
    for i, (own, both, exact) in enumerate(zip(leads, known, sure, strict=True)):
        for lead, k, x in zip(own, both, exact, strict=True):
            if k >= 0:
                most, rest = out.setdefault(lead, (np.full(len(n), np.inf), np.full(len(n), np.inf)))
                most[i] = k
                if x:
                    rest[i] = n[i] - k
    return list(out.values())


def _nearest(owner: np.ndarray, far: np.ndarray, most: int, cut: np.ndarray) -> np.ndarray:
    """Places of the `most` pairs of each owner that are least far; marks in cut the owners that have more."""
    order = np.lexsort((far, owner))
    own = owner[order]
    head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((head, [len(own)])))
    cut[own[head[size > most]]] = True
    return order[np.arange(len(own)) - np.repeat(head, size) < most]


def _across(threshold: int, most: int):
    """Entries of long lists with their components -> pairs between different components, block by block.

    Left out are pairs that the leaders' answers rule out, and those whose signatures differ in more
    bits than the threshold allows tokens. Each set gives its `most` nearest sets that come before it by size; `more`
    says that it has others in the list of this token.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, ["token", "tile"]):
            for (token, _), g in pdf.groupby(["token", "tile"], sort=False):
                g = g.sort_values(["n", "cls"])
                cls, n, pos, comp, left, right = (g[c].to_numpy() for c in ("cls", "n", "pos", "comp", "left", "right"))
                if (comp == comp[0]).all():
                    continue
                rest = n - pos
                bounds = _bounds(g["leads"].tolist(), g["known"].tolist(), g["sure"].tolist(), n)
                sig = np.frombuffer(b"".join(g["sig"]), np.uint64).reshape(len(g), -1)
                blocks = [slice(i, min(i + _GRAIN, len(n))) for i in range(0, len(n), _GRAIN)]
                cut = np.zeros(len(n), bool)
                a, b, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
                for i, x in enumerate(blocks):
                    for y in blocks[i:]:
                        # sizes rise from block to block; past the range, and where no position leaves enough, skip the block
                        if 100 * n[x][-1] < threshold * n[y][0]:
                            break
                        if (100 + threshold) * min(rest[x].max(), rest[y].max()) < threshold * (n[x][0] + n[y][0]):
                            continue
                        ok = _fits(n[x][:, None], pos[x][:, None], n[y][None, :], pos[y][None, :], threshold)
                        ok &= comp[x][:, None] != comp[y][None, :]
                        ok &= (left[x][:, None] & right[y][None, :]) | (right[x][:, None] & left[y][None, :])
                        if x is y:
                            ok = np.triu(ok, 1)
                        i1, i2 = np.nonzero(ok)
                        total = n[x][i1] + n[y][i2]
                        for shared, lack in bounds:
                            both = np.minimum(shared[x][i1] + lack[y][i2], lack[x][i1] + shared[y][i2])
                            near = (100 + threshold) * both >= threshold * total
                            i1, i2, total = i1[near], i2[near], total[near]
                        bits = np.zeros(len(i1), np.int64)
                        for k in range(sig.shape[1]):
                            bits += np.bitwise_count(sig[x, k][i1] ^ sig[y, k][i2])
                        near = np.flatnonzero((100 + threshold) * bits <= (100 - threshold) * total)
                        near = near[_nearest(i2[near] + y.start, bits[near] / total[near], most, cut)]
                        a.append(i1[near] + x.start)
                        b.append(i2[near] + y.start)
                        far.append(bits[near] / total[near])
                first, second = np.concatenate(a), np.concatenate(b)
                kept = _nearest(second, np.concatenate(far), most, cut)
                if len(kept):
                    yield pd.DataFrame({"a": cls[first[kept]], "b": cls[second[kept]], "token": token, "more": cut[second[kept]]})

    return run


def _classes(texts: list[str]) -> list[tuple[int, int]]:
    return [_hashes(s) for s in _sets(texts)]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, sa, nb, sb) -> (a, b, na, nb, most): how many tokens the sets share at most, by their signatures."""
    for rows in batches:
        na, nb = (rows.column(i).to_numpy() for i in (2, 4))
        bits = np.fromiter(map(apart, rows.column(3).to_pylist(), rows.column(5).to_pylist()), np.int64, rows.num_rows)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), rows.column(4), pa.array((na + nb - bits) // 2)], names=["a", "b", "na", "nb", "most"])


def _answers(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, reps: DataFrame, clashes: DataFrame | None, threshold: int) -> DataFrame:
    """(a, b, na, nb, both, sure) for pairs(a, b) of classes: the tokens they share, or, if not sure, a bound that rules out a link.

    Only pairs that their signatures leave open move the whole texts.
    """
    of = lambda k: sigs.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    both = pairs.distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    both = scratch(both.mapInArrow(_bounded, "a long, b long, na long, nb long, most long"), "bounded")
    may = F.expr(f"{100 + threshold} * most >= {threshold} * (na + nb)")
    open_ = both.where(may)
    wanted = open_.select(F.col("a").alias("cls")).unionAll(open_.select(F.col("b").alias("cls"))).distinct()
    texts = scratch(class_texts(docs, wanted, reps, clashes, _classes), "texts")
    # a leader's pairs may be a large share of all: so many of them to a task
    many = open_.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > 500).select(F.col("a").alias("k"), F.ceil(F.col("c") / 500).cast("long").alias("salts"))
    dealt = open_.join(many, F.col("a") == F.col("k"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt"))
    dealt = scratch(dealt, "dealt")
    right = dealt.join(texts, F.col("b") == F.col("cls")).select("a", "salt", F.lit(1).alias("side"), "b", "z")
    left = dealt.select("a", "salt").distinct().join(texts, F.col("a") == F.col("cls")).select("a", "salt", F.lit(0).alias("side"), F.lit(0).cast("long").alias("b"), "z")  # no null: pandas would turn b to doubles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        own, key = np.empty(0, np.uint64), None
        for pdf in batches:
            out = []
            raw = [unpack.decompress(z).lower() for z in pdf["z"]]
            for x, y, side, w in zip(pdf["a"], pdf["b"], pdf["side"], word_hashes(raw), strict=True):
                s = shingle_set(w)
                if side == 0:
                    own, key = s, x
                elif key == x:
                    out.append((x, int(y), len(own), len(s), len(np.intersect1d(own, s, assume_unique=True))))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "na", "nb", "both"])

    sides = left.unionAll(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    sure = sides.mapInPandas(run, "a long, b long, na long, nb long, both long").withColumn("sure", F.lit(True))
    out = scratch(sure.unionAll(both.where(~may).select("a", "b", "na", "nb", F.col("most").alias("both"), F.lit(False).alias("sure"))), "answers")
    for x in (both, texts, dealt):
        drop_scratch(x)
    return out


def _links(answers: DataFrame, threshold: int) -> DataFrame:
    return answers.where(F.expr(f"sure AND {100 + threshold} * both >= {threshold} * (na + nb)")).select("a", "b")


def _spanning(links: DataFrame) -> DataFrame:
    """Fewer links(a, b) that connect the same sets: each b to its least a, and that one to b's other ones, once.

    Sets of one group mostly meet the same others, so of the links between those few are distinct.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    between = links.withColumn("m", least).where("a <> m").select("a", F.col("m").alias("b")).distinct()
    return links.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionAll(between)


def join_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, class_id), one row for each row of docs.

    Links are sets with 100 * |a & b| >= threshold * |a | b|. A document without words (or a null
    text) has an empty set, links with nothing and is its own component. Repeated texts are one
    class; rows that share a doc_id count as one node each. A row with a null doc_id links by its text
    like others; its component is the least id of the group, null if no row of the group has one.
    class_id tells equal sets apart from linked ones.
    """
    return _grouped(docs, threshold).select("doc_id", "n_shingles", "component_id", "class_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of linked or equal texts stays.

    It is the one of the least doc_id, ids before null; of rows with that id the one of the least row
    key, and of rows with the same id and text any one. Rows without words are groups of their own.
    """
    spark = docs.sparkSession

    def decided() -> DataFrame:
        """(rk, single): keys of the rows that go, and of those of which one stays."""
        rows = _grouped(docs, threshold).where("n_shingles > 0").select("group_id", "doc_id", "rk")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk"))["rk"].alias("best")
        first = rows.groupBy("group_id").agg(best)
        copies = rows.groupBy("group_id", "rk").agg(F.count("*").alias("copies"))
        each = copies.join(first, "group_id").select("rk", (F.col("rk") == F.col("best")).alias("single"), "copies")
        return each.where("NOT single OR copies > 1").select("rk", "single")

    # most rows are in no group: they stay where they lie, only rows that may be decided on meet the decisions
    key, may, decision, single = free(docs, "row_key", "may_go", "decided_key", "one_stays")
    gone = kept_alone(spark, decided, "decided").toDF(decision, single)
    rows = marked(docs.withColumn(key, F.xxhash64("doc_id", "text")), F.col(key), gone.select(decision), may)
    met = rows.where(F.col(may)).join(gone, F.col(key) == F.col(decision), "left")
    out = rows.where(~F.col(may)).select(*docs.columns).unionAll(met.where(F.col(decision).isNull()).select(*docs.columns))
    if gone.where(F.col(single)).isEmpty():
        return out
    return out.unionAll(met.where(F.col(single)).dropDuplicates([key]).select(*docs.columns))


def _mixed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """(token, c): of the lists of rows(token, cls, ...) those that hold several components, and their lengths."""
    rows = rows.join(comps, F.col("cls") == F.col("node"), "left").select("token", F.coalesce("component", "cls").alias("comp"))
    return rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("token", "c")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([fold(x, FOLDED // 8) for x in rows.column(1).to_pylist()], pa.binary())], names=["k", "sig"])


def _told(lists: DataFrame, comps: DataFrame, answers: DataFrame, sigs: DataFrame) -> DataFrame:
    """Entries of the lists(token, cls, n, pos, leads) that hold several components, with what all rounds are told of them."""
    mixed = _mixed(lists, comps).select(F.col("token").alias("k"), F.ceil(F.col("c") / TILE_ROWS).cast("int").alias("blocks"))
    rows = lists.join(mixed, F.col("token") == F.col("k")).drop("k")
    # the leaders' answers about each entry, LEADERS at most; a leader shares all its tokens with itself
    told = rows.withColumn("lead", F.explode("leads")).drop("leads").join(answers.select("a", "b", "both", "sure"), (F.col("lead") == F.col("a")) & (F.col("cls") == F.col("b")), "left")
    itself = F.col("lead") == F.col("cls")
    told = told.withColumn("known", F.when(itself, F.col("n")).otherwise(F.coalesce("both", F.lit(-1)))).withColumn("sure", itself | F.coalesce("sure", F.lit(False)))
    rows = told.groupBy("token", "cls", "n", "pos", "blocks").agg(F.collect_list(F.struct("lead", "known", "sure")).alias("told"))
    rows = rows.select("token", "cls", "n", "pos", "blocks", F.col("told.lead").alias("leads"), F.col("told.known").alias("known"), F.col("told.sure").alias("sure"))
    near = sigs.select("cls", "sig").mapInArrow(_folded, "k long, sig binary")
    return rows.join(near, F.col("cls") == F.col("k")).drop("k")


def _tiles(told: DataFrame, comps: DataFrame, left_open: DataFrame | None) -> DataFrame:
    """The told entries with their components, dealt out to tiles; of the lists left_open(token) only, if given, that hold several components."""
    rows = told
    if left_open is not None:
        lists = _mixed(told.select("token", "cls").join(left_open, "token", "left_semi"), comps).select("token")
        rows = marked(rows, F.col("token"), scratch(lists, "mixed"), "is_open").where("is_open").drop("is_open")
    rows = rows.join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("token", (lo.cast("long") * F.col("blocks") + hi).alias("tile"), "cls", "n", "pos", "comp", "leads", "known", "sure", (F.col("own") == lo).alias("left"), (F.col("own") == hi).alias("right"), "sig")
    return rows.repartition("token", "tile").sortWithinPartitions("token", "tile")


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, class_id, group_id): group_id names a component whatever its rows' ids."""
    spark = docs.sparkSession
    frequent, _ = frequent_tokens(docs)
    whole = scratch(_index(docs, frequent, threshold), "index")
    index, reps, clashes = find_classes(whole, "n > 0")
    sigs = scratch(index.where(F.col("sig").isNotNull()).groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "signatures")
    entries = index.where(F.col("prefix").isNotNull()).select("cls", "n", F.posexplode("prefix").alias("pos", "token"))
    long = scratch(entries.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > LIST_ROWS).select(F.col("token").alias("hot"), F.ceil(F.col("n") / LIST_ROWS).alias("salts")), "long-lists")
    if many := long.count():
        salts = F.broadcast(long) if many <= FREQUENT else long
        entries = entries.join(salts, F.col("token") == F.col("hot"), "left").withColumn("salt", F.coalesce(F.pmod("cls", "salts") + 1, F.lit(0)))
    else:
        entries = entries.withColumn("salt", F.lit(0).cast("long"))
    entries = entries.select("token", "salt", "cls", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"))
    entries = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "cls")
    found = scratch(entries.mapInPandas(_leaders(threshold), "kind int, a long, b long, n long, pos long, leads array<long>"), "found")
    index = scratch(index.select("doc_id", "rk", "n", "cls"), "documents")
    drop_scratch(whole)
    answers = _answers(found.where("kind = 0").select("a", "b"), sigs, docs, reps, clashes, threshold)
    first = scratch(components(_spanning(_links(answers, threshold))), "first")

    # what is left: long lists that hold several components
    lists = scratch(found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cls"), "n", "pos", "leads"), "lists")
    drop_scratch(found)
    told = scratch(_told(lists, first, answers, sigs), "told")
    for x in (lists, answers):
        drop_scratch(x)
    most, tried, left_open = NEAREST, None, None
    while True:
        more = scratch(_tiles(told, first, left_open).mapInPandas(_across(threshold, most), "a long, b long, token long, more boolean"), "across")
        pairs = more.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch(pairs, "pairs")
        if not pairs.isEmpty():
            got = _answers(pairs, sigs, docs, reps, clashes, threshold)
            links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(_spanning(_links(got, threshold)))
            first = scratch(components(links), "both")
            tried = pairs if tried is None else tried.unionAll(pairs)
        left_open = more.where("more").select("token").distinct()  # in the other lists all pairs were asked for or ruled out
        if left_open.isEmpty():
            break
        most *= FURTHER

    ids = first.join(reps, F.col("node") == F.col("cls")).groupBy("component").agg(F.min("rep").alias("component_id"))
    named = first.join(ids, "component").select(F.col("node").alias("named"), "component", "component_id")
    named = reps.join(named, F.col("cls") == F.col("named"), "left").select(F.col("cls").alias("k"), F.coalesce("component", "cls").alias("group_id"), F.coalesce("component_id", "rep").alias("component_id"))
    out = index.select("doc_id", "rk", "n", "cls").join(named, (F.col("cls") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id"), "group_id")
