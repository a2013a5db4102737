"""Token-ID output in Parquet list columns, and reading it back selectively.

Format: a folder of Parquet files in ascending doc_id order (files by name, rows within a file).
Columns: doc_id, part (number of the file's range), at (ids of the part before the row), n_tokens,
ids (list of int). The ids use dictionary encoding, the counters delta encoding where the writer's
version 2 pages allow it; row groups and pages have set sizes and carry page indexes and statistics,
so a range of doc_id, or the metadata columns alone, can be read without the rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import drop_caches, keep_between_tasks, scratch_path

if TYPE_CHECKING:
    from tokenizers import Tokenizer

SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Bytes of input for one file of tokens.
FILE_BYTES = 128 << 20
#: Entries of a worker's cache from a chunk of text to its ids; beyond that only the KEPT most used ones stay.
CACHE, KEPT = 400_000, 200_000
#: Words that the tokenizer itself remembers.
WORDS_CACHED = 1000
#: Bytes of the unknown chunks that the tokenizer gets as one text.
JOINED = 1 << 11
#: Marks a chunk that follows no space; texts that hold it are encoded whole.
_BARE = "\x00"
#: Other white space than single spaces and line feeds between two other characters, or the mark itself.
_ODD = "[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
#: Bytes of text that are encoded at once.
SLICE_BYTES = 2 << 20


def _lean(tok: Tokenizer) -> Tokenizer:
    """The tokenizer with a small word cache of its own, as it gets new words only; its ids stay the same."""
    from tokenizers import models

    spec = json.loads(tok.to_str())["model"]
    if spec.pop("type", None) == "BPE":
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec.pop("merges")]
        tok.model = models.BPE(vocab=spec.pop("vocab"), merges=merges, cache_capacity=WORDS_CACHED, **{k: v for k, v in spec.items() if v is not None})
    return tok


class ChunkEncoder:
    """Encodes whole texts through a cache of chunks, giving exactly the tokenizer's ids.

    The byte-level pre-tokenizer always begins a piece at a single space or line feed between two
    other characters, and no merge crosses pieces; so a text cut there encodes chunk by chunk. A
    text with other white space, doubled white space or white space at its ends is encoded whole,
    and so is one that holds the string of an added token, which the tokenizer gives that token's id.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = _lean(Tokenizer.from_file(path))
        self.odd = "|".join([_ODD, *(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())])
        vocab = self.tok.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # of each token: its name has a character for each
        self.bytes[list(vocab.values())] = [len(t) for t in vocab]
        self.at: dict[str, int] = {}  # chunk -> its number
        self.flat, self.start, self.length, self.uses = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0  # of flat

    def _shrink(self) -> None:
        n = len(self.at)
        stay = np.sort(np.argpartition(-self.uses[:n], KEPT)[:KEPT]) if n > KEPT else np.arange(n)
        keys = list(self.at)
        self.at = dict(zip(map(keys.__getitem__, stay.tolist()), range(len(stay)), strict=True))
        start, length = self.start[stay], self.length[stay]
        ends = np.cumsum(length)
        flat = self.flat[np.arange(ends[-1]) + np.repeat(start - ends + length, length)]
        self.used = len(flat)
        self.flat[: self.used] = flat
        self.start[: len(stay)], self.length[: len(stay)] = ends - length, length
        self.uses[: len(stay)], self.uses[len(stay) :] = (self.uses[stay] + 1) // 2, 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.StringArray) -> None:
        """Encode these chunks and give them the next numbers; their strings are noted by the caller.

        They are put together to texts, a line feed before each chunk that follows no space, as chunks
        do not touch each other; the tokens' bytes tell where each chunk ends.
        """
        bare = pc.starts_with(new, _BARE)  # the mark is nowhere else
        lead = bare.to_numpy(zero_copy_only=False)
        parts = pc.replace_substring(pc.binary_join_element_wise(pc.if_else(pc.or_(bare, pc.equal(new, "\n")), "", " "), new, ""), _BARE, "\n").cast(pa.large_string())
        _, offsets, data = parts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1]
        ends = bounds[1:] - bounds[0]
        cuts = np.flatnonzero(np.diff(ends // JOINED, prepend=-1, append=-1))
        joined = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(bounds[cuts]), data)
        flat = np.concatenate(self._whole(joined.to_pylist()))
        last = np.searchsorted(np.cumsum(self.bytes[flat]), ends) + 1
        first = np.concatenate(([0], last[:-1])) + lead  # without the line feed put before it
        n = last - first
        keep = np.ones(len(flat), bool)
        keep[first[lead] - 1] = False
        flat = flat[keep]
        lo, end = len(self.at), self.used + len(flat)
        hi = lo + len(new)
        if hi > len(self.start):
            self.start, self.length, self.uses = (np.concatenate((x, np.zeros(max(hi - len(x), len(x)), np.int64))) for x in (self.start, self.length, self.uses))
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(end - len(self.flat), len(self.flat)), np.int32)))
        self.start[lo:hi], self.length[lo:hi] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : end] = flat
        self.used = end

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many are of each). A null text is an empty one."""
        empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0)
        odd = pc.and_not(pc.fill_null(pc.match_substring_regex(texts, self.odd), False), empty)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = np.flatnonzero(~pc.or_(odd, empty).to_numpy(zero_copy_only=False))
        # a chunk is what a space precedes; a line feed is one of its own, and marks the chunk after it
        marked = pc.binary_join_element_wise(_BARE, pc.replace_substring(texts.take(pa.array(cut)), "\n", f" \n {_BARE}"), "")
        lists = pc.split_pattern(marked, " ")
        many, chunks = np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
        if len(self.at) > CACHE:
            self._shrink()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        k = np.fromiter(map(self.at.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(k < 0)
        if len(new):
            k[new] = np.arange(len(self.at), len(self.at) + len(new))
            self._learn(chunks.dictionary.take(pa.array(new)))
            self.at.update(zip(map(names.__getitem__, new.tolist()), k[new].tolist(), strict=True))
        at = chunks.indices.to_numpy()
        self.uses[k] += np.bincount(at, minlength=len(k))
        k = k[at]
        n = self.length[k]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[k] - ends + n, n)] if len(k) else np.empty(0, np.int32)
        size = np.zeros(len(texts), np.int64)
        if len(cut):
            size[cut] = np.add.reduceat(n, np.cumsum(many) - many)
        if len(whole):  # put between the others
            out = np.split(ids, np.cumsum(size)[:-1])
            for i, x in zip(whole.tolist(), self._whole(texts.take(pa.array(whole)).to_pylist()), strict=True):
                out[i], size[i] = x, len(x)
            ids = np.concatenate(out)
        return ids, size


def _slices(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES)))
        yield lo, hi
        lo = hi


_encoders: dict[str, ChunkEncoder] = {}
keep_between_tasks(_encoders.clear)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for that file; its cache lives until the worker is put to other work."""
    if path not in _encoders:
        drop_caches()
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _input_bytes(docs: DataFrame) -> int:
    """Bytes of the files that docs reads, as the optimizer knows them; 0 if it does not."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode docs(doc_id, text, ...) and write them in ascending doc_id order.

    A null text is an empty one: only the end id. Rows that share a doc_id stay separate, next to
    each other, null ids first. Ranges of doc_id are cut by sampled quantiles, so files are alike in
    rows; their number follows the bytes of the input, and is the session's shuffle partitions at least.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), _input_bytes(docs) // FILE_BYTES)
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for big in batches:
            for lo, hi in _slices(big.column(1)):
                b = big.slice(lo, hi - lo)
                flat, lens = enc.encode(b.column(1))
                flat = np.insert(flat, np.cumsum(lens), np.int32(end_id))
                lens += 1
                offsets = np.concatenate(([0], np.cumsum(lens)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(lens), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(lens), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
                    names=["doc_id", "part", "at", "n_tokens", "ids"],
                )
                at += int(offsets[-1])

    out = ranged.mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids array<int>")
    (
        out.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#at", "false").option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before the row.

    Asking for some columns or a range of doc_id reads only those columns, row groups and pages.
    """
    df = spark.read.schema(SCHEMA).parquet(path)
    return df.join(_bases(df), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def _bases(df: DataFrame) -> DataFrame:
    """(part, base): ids before each file range; a row a range."""
    parts = df.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches()  # the encoder, which has written the files
    for b in batches:
        ids = b.column(3)
        flat, offs = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        offs = offs - offs[0]
        crc = [zlib.crc32(flat[lo:hi]) for lo, hi in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, type=pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files; the ids themselves are read where they lie and not moved."""
    df = spark.read.schema(SCHEMA).parquet(path)
    crc = df.select("doc_id", "part", "at", "ids").mapInArrow(_crc, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return crc.join(_bases(df), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write to the shared folder, read the files back, and return their digest."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return digest(spark, path)
