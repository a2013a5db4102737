"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their tokens end together.

Texts are cut into chunks at single spaces between two other characters. Neither tokenizer has a token
across such a place (a byte-level BPE begins a piece there, and no piece of the other vocabulary has a
space mark after another character), so a chunk has the same tokens wherever it stands. Chunks new to a
worker are tokenized and aligned together, in arrays: running sums of the tokens' bytes are their
ends, ends in both are the cuts, a search of the cuts numbers the groups, and repeats make the links.
A document is then put together from its chunks.

Counts of the id pairs are summed in two stages, first by pair and a salt, then by pair. Documents ask
for their pairs' counts in one of two ways: the most frequent pairs, MOST_KNOWN at most, are sent to all
tasks; for all others the pairs of the documents meet the counts in a join, in which no pair is frequent.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_store import _lean, _slices
from .util import drop_caches, keep_between_tasks, scratch

#: Chunks that a worker keeps aligned; beyond CACHE only the KEPT most used ones stay, none longer than KEPT_CHARS.
CACHE, KEPT, KEPT_CHARS = 100_000, 60_000, 64
#: Bytes of chunks tokenized as one text.
JOINED = 1 << 11
#: Such texts that are tokenized at once.
TOGETHER = 32
#: Pairs whose counts are sent to all tasks, at most: 17 bytes each.
MOST_KNOWN = 1 << 18
#: Salts of the first stage of counting.
SALTS = 16
#: Pairs that a task gathers before it hands their counts on.
GATHERED = 1 << 20
#: A single space that no other white space touches is where chunks part; \s has all that either tokenizer takes for white space.
_PART = re.compile(r"(?<=\S) (?=\S)")
#: Texts with other white space than single spaces and line feeds within are cut by _PART; all others at each space.
_ODD = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
#: The mark of a space in a vocabulary of pieces.
_MARK = "▁"

SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>"


def _byte_names() -> dict[str, int]:
    """The characters by which a byte-level BPE names bytes: printable ones stand for themselves, the others follow from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE = _byte_names()


class Aligner:
    """Chunk -> its tokens, groups and links, learned as chunks come."""

    def __init__(self, byte_bpe: str, pieces: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = _lean(Tokenizer.from_file(byte_bpe))
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        vocab, special = self.a.get_vocab(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_raw = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_raw[i] = b"" if name in special else bytes(map(_BYTE.__getitem__, name))
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_raw = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(names)]
        self.a_bytes, self.b_bytes = (np.array([len(x) for x in raw], np.int64) for raw in (self.a_raw, self.b_raw))
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((0, 5), np.int64)  # tokens of A and of B, groups, links, whether the bytes are the chunk's
        self.links, self.uses = np.empty(0, np.int64), np.empty(0, np.int64)

    def _shrink(self) -> None:
        n, names = len(self.groups), list(self.at)
        stay = np.zeros(n, bool)
        stay[np.argpartition(-self.uses, KEPT)[:KEPT] if n > KEPT else np.arange(n)] = True
        stay &= np.fromiter((len(c) <= KEPT_CHARS for c in names), bool, n)
        self.links = self.links[np.repeat(stay, self.counts[:, 3])]
        kept = np.flatnonzero(stay).tolist()
        self.at = {names[i]: k for k, i in enumerate(kept)}
        self.groups = [self.groups[i] for i in kept]
        self.counts, self.uses = self.counts[stay], (self.uses[stay] + 1) // 2

    def _of(self, texts: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """For each text its tokens by both, and whether the bytes of both are a space and the text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        return [(x, y, b"".join(map(self.a_raw.__getitem__, x)) == b"".join(map(self.b_raw.__getitem__, y)) == b" " + t.encode()) for t, x, y in zip(texts, a, b, strict=True)]

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, bytes of each chunk and the space before it), chunk after chunk; a chunk whose bytes differ has none."""
        sizes = np.array([len(c.encode()) + 1 for c in chunks], np.int64)
        # white space at a chunk's ends must not touch the space between chunks put together
        alone = np.array([c != c.strip() for c in chunks])
        cuts = np.flatnonzero((np.diff(np.cumsum(sizes) // JOINED, prepend=-1) != 0) | alone | np.concatenate(([False], alone[:-1]))).tolist()
        bounds = list(zip(cuts, [*cuts[1:], len(chunks)], strict=True))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(bounds), TOGETHER):  # what the libraries return is several times the ids, so not all at once
            some = bounds[at : at + TOGETHER]
            for (lo, hi), (x, y, same) in zip(some, self._of([" ".join(chunks[lo:hi]) for lo, hi in some]), strict=True):
                for i, (p, q, good) in enumerate([(x, y, True)] if same else self._of(chunks[lo:hi])):
                    if good:
                        a.append(np.array(p, np.int64))
                        b.append(np.array(q, np.int64))
                    else:
                        sizes[lo + i] = 0
        return np.concatenate(a), np.concatenate(b), sizes

    def learn(self, chunks: list[str]) -> None:
        """Tokenize and align chunks, all in one."""
        a, b, sizes = self._tokens(chunks)
        a_ends, b_ends, ends = np.cumsum(self.a_bytes[a]), np.cumsum(self.b_bytes[b]), np.cumsum(sizes)
        n_a, n_b = (np.diff(np.searchsorted(e, ends, "right"), prepend=0) for e in (a_ends, b_ends))
        cuts = np.intersect1d(a_ends, b_ends)
        # every token that ends at a cut is linked with every token of the other side that ends there
        a_from, a_to = np.searchsorted(a_ends, cuts, "left"), np.searchsorted(a_ends, cuts, "right")
        b_from, b_to = np.searchsorted(b_ends, cuts, "left"), np.searchsorted(b_ends, cuts, "right")
        many = (a_to - a_from) * (b_to - b_from)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        wide = np.repeat(b_to - b_from, many)
        pairs = (a[np.repeat(a_from, many) + k // wide] << 32) | b[np.repeat(b_from, many) + k % wide]
        of_cut = np.searchsorted(ends, cuts, "left")  # the chunk of each group
        groups, links = np.bincount(of_cut, minlength=len(chunks)), np.bincount(of_cut, many, len(chunks)).astype(np.int64)
        # the groups as text: each token with the mark after it, a group's tokens of A before those of B
        closing = np.concatenate((np.diff(of_cut) != 0, [True]))[: len(cuts)]  # of its chunk
        a_group, b_group = np.searchsorted(cuts, a_ends, "left"), np.searchsorted(cuts, b_ends, "left")
        a_last, b_last = a_to[a_group] - 1 == np.arange(len(a)), b_to[b_group] - 1 == np.arange(len(b))
        at_a, at_b = np.arange(len(a)) + np.concatenate(([0], b_to[:-1]))[a_group], np.arange(len(b)) + a_to[b_group]
        ids, after = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        after[at_a], after[at_b] = np.where(a_last, 1, 0), np.where(b_last, np.where(closing[b_group], 3, 2), 0)
        parts = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), pa.array([",", "|", ";", ""]).take(pa.array(after)), "")
        offsets = pa.array(np.concatenate(([0], np.cumsum(n_a + n_b))).astype(np.int32))
        self.at.update((c, len(self.groups) + i) for i, c in enumerate(chunks))
        self.groups += pc.binary_join(pa.ListArray.from_arrays(offsets, parts), "").to_pylist()
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, groups, links, sizes > 0), 1)))
        self.links, self.uses = np.concatenate((self.links, pairs)), np.concatenate((self.uses, np.zeros(len(chunks), np.int64)))

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The number of each chunk; new ones are learned."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.groups) > CACHE:
            self._shrink()
        if new := [c for c in names if c not in self.at]:
            self.learn(new)
        k = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))
        at = coded.indices.to_numpy()
        self.uses[k] += np.bincount(at, minlength=len(k))
        return k[at]

    def align(self, texts: pa.StringArray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(tokens of A, of B, groups and links by text; hash of the groups by text; pairs of all texts, one text after the other)."""
        size = len(texts)
        empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0)
        odd = pc.and_not(pc.fill_null(pc.match_substring_regex(texts, _ODD), False), empty)
        plain, other = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (pc.invert(pc.or_(empty, odd)), odd))
        counts, hashes, rows = np.zeros((size, 4), np.int64), [""] * size, np.concatenate((plain, other))
        if not len(rows):
            return counts, hashes, np.empty(0, np.int64)
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        cut = [_PART.split(t) for t in texts.take(pa.array(other)).to_pylist()]
        many = np.concatenate((np.diff(lists.offsets.to_numpy()).astype(np.int64), np.array([len(c) for c in cut], np.int64)))
        k = self._numbers(pa.concat_arrays([lists.flatten(), pa.array([c for x in cut for c in x], pa.string())]))
        first = np.cumsum(many) - many
        same = np.minimum.reduceat(self.counts[k, 4], first) == 1
        counts[rows] = np.add.reduceat(self.counts[k, :4], first) * same[:, None]
        names = k.tolist()
        for i, lo, n, good in zip(rows.tolist(), first.tolist(), many.tolist(), same.tolist(), strict=True):
            if good:
                hashes[i] = hashlib.sha256(";".join(map(self.groups.__getitem__, names[lo : lo + n])).encode()).hexdigest()
        k = k[np.repeat(same, many)]
        if len(other):  # back to the order of the rows
            k = k[np.argsort(np.repeat(rows[same], many[same]), kind="stable")]
        n = self.counts[k, 3]
        starts, ends = np.cumsum(self.counts[:, 3]) - self.counts[:, 3], np.cumsum(n)
        return counts, hashes, self.links[np.arange(n.sum()) + np.repeat(starts[k] - ends + n, n)]


_aligners: dict[tuple[str, str], Aligner] = {}
keep_between_tasks(_aligners.clear)


def aligner(byte_bpe: str, pieces: str) -> Aligner:
    """The worker's aligner for these files."""
    if (byte_bpe, pieces) not in _aligners:
        drop_caches()
        _aligners[byte_bpe, pieces] = Aligner(byte_bpe, pieces)
    return _aligners[byte_bpe, pieces]


def aligned(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """docs(doc_id, text) -> a row each with its counts, the hash of its groups and its pairs as two lists; `row` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, of = TaskContext.get().partitionId() << 40, aligner(byte_bpe, pieces)
        for big in batches:
            for lo, hi in _slices(big.column(1)):
                b = big.slice(lo, hi - lo)
                counts, hashes, pairs = of.align(b.column(1))
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts[:, 3]))).astype(np.int32))
                sides = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs >> 32, pairs & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(b))), b.column(0), *(pa.array(counts[:, i]) for i in range(4)), pa.array(hashes, pa.string()), *sides],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"],
                )
                row += len(b)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
    return (a << 32) | b


def _sides(keys: np.ndarray) -> list[pa.Array]:
    return [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32))]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a task with their counts, summed as far as GATHERED pairs go."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % SALTS

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*_sides(keys), pa.array(np.full(len(keys), salt, np.int32)), pa.array(n)], names=["a", "b", "salt", "n"])

    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        new, many = np.unique(_keys(batch), return_counts=True)
        keys, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
        n = np.bincount(at, np.concatenate((n, many)), len(keys)).astype(np.int64)
        if len(keys) > GATHERED:
            yield out(keys, n)
            keys, n = keys[:0], n[:0]
    if len(keys):
        yield out(keys, n)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(a, b, n, best): the links of each pair over all documents, and whether no pair of that b has more.

    Two stages: sums by pair and salt, then by pair. The highest count of a b is one row for each id of
    that vocabulary, and so no larger than the vocabulary.
    """
    salted = parts.select("a", "b").mapInArrow(_gathered, "a int, b int, salt int, n long").groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    counts = scratch(salted.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return scratch(counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _frequent(counts: DataFrame) -> int:
    """The least power of two that at most MOST_KNOWN pairs reach with their counts."""
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()  # 63 rows at most
    total, least = 0, 62
    for power, pairs in sorted(((r.power, r.pairs) for r in steps), reverse=True):
        total += pairs
        if total > MOST_KNOWN:
            break
        least = power
    return 1 << least


def _asked(keys: np.ndarray, n: np.ndarray, best: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the known pairs of each row; its other pairs once each, with how often they are there."""
    for batch in batches:
        offsets = batch.column(batch.schema.get_field_index("a")).offsets.to_numpy()
        asked, row = _keys(batch), np.repeat(np.arange(len(batch)), np.diff(offsets))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        known = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
        sums, bests = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        np.add.at(sums, row[known], n[at[known]])
        np.add.at(bests, row[known], best[at[known]])
        row, asked = row[~known], asked[~known]
        order = np.lexsort((asked, row))
        row, asked = row[order], asked[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(asked) != 0)))[: len(row)])
        times = np.diff(np.concatenate((first, [len(row)]))) if len(row) else first
        rest = pa.StructArray.from_arrays([*_sides(asked[first]), pa.array(times.astype(np.int64))], names=["a", "b", "times"])
        cuts = pa.array(np.searchsorted(row[first], np.arange(len(batch) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(cuts, rest)], names=["row", "n_best", "count_sum", "rest"])


def align(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A is the byte-level BPE over a space and the text, B the piece vocabulary over the text. A text that is
    null or empty, or that either does not give back byte by byte, has zeros and an empty hash. Rows that
    share a doc_id, or have none, stay separate, and repeated rows count as often as they are there. One row for
    each row of docs.
    """
    spark = docs.sparkSession
    parts = scratch(aligned(docs, byte_bpe, pieces), "aligned")
    counts = pair_counts(parts)
    least = _frequent(counts)
    known = counts.where(F.col("n") >= least).toPandas()  # MOST_KNOWN rows at most
    keys = (known["a"].to_numpy(np.int64) << 32) | known["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], known["n"].to_numpy(np.int64)[order], known["best"].to_numpy(np.int64)[order]))
    asked = scratch(parts.select("row", "a", "b").mapInArrow(lambda batches: _asked(*sent.value, batches), "row long, n_best long, count_sum long, rest array<struct<a:int,b:int,times:long>>"), "asked")
    rest = asked.select("row", F.inline("rest")).join(counts.where(F.col("n") < least), ["a", "b"])
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    zero = F.lit(0).cast("long")
    return (
        parts.drop("a", "b").join(asked.drop("rest"), "row").join(rest, "row", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256")
    )
