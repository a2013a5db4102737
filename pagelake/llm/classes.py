"""Classes of equal documents, and fetching the text of chosen classes without moving all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import scratch

#: Bits of the filter: 16 for each wanted text, within these bounds. Beyond the upper one more texts than wanted are moved, none is lost.
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 27


def row_key(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, text, rk). Rows of equal id and text share a key; a null id is an id like others."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))


def find_classes(index: DataFrame, has: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """index(doc_id, rk, h, chk, ...) -> (index with cls, reps(cls, rep, rk), clashes).

    h and chk are two independent 64-bit hashes; rows that agree in both are a class. Its name cls is
    h, or, if classes of different chk share an h, a number made of both; clashes holds those h.
    reps are of the rows that satisfy `has`: rep is the least doc_id, null ids left out, rk the key of one of the rows.
    """
    per = index.where(has).groupBy("h").agg(F.min("doc_id").alias("rep"), F.min("rk").alias("rk"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
    per = scratch(per, "classes")
    clashes = per.where("lo <> hi").select(F.col("h").alias("clash"))
    if clashes.isEmpty():
        return index.withColumnRenamed("h", "cls").drop("chk"), per.select(F.col("h").alias("cls"), "rep", "rk"), None
    index = name_classes(index, clashes).drop("h", "chk")
    return index, scratch(index.where(has).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("rk").alias("rk")), "named"), clashes


def name_classes(df: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """df(h, chk, ...) with cls."""
    if clashes is None:
        return df.withColumn("cls", F.col("h"))
    df = df.join(clashes, F.col("h") == F.col("clash"), "left")
    return df.withColumn("cls", F.when(F.col("clash").isNull(), F.col("h")).otherwise(F.xxhash64("h", "chk"))).drop("clash")


def class_texts(docs: DataFrame, wanted: DataFrame, reps: DataFrame, clashes: DataFrame | None, classify: Callable[[list[str]], list[tuple[int, int]]]) -> DataFrame:
    """(cls, z): a zstd-compressed text for each wanted(cls), found by the row key of one of its documents in reps(cls, rk, ...).

    A bit array keeps most other documents out of the shuffle; it may let some through, never hold
    a wanted one back. `classify` gives (h, chk) of each text.
    """
    need = scratch(wanted.join(reps.select("cls", "rk"), "cls"), "need")
    bits = min(max(1 << (16 * need.count()).bit_length(), _LEAST_BITS), _MOST_BITS)
    bit = F.pmod(F.xxhash64("rk"), F.lit(bits)) + 1  # buckets begin at 1, so do the bits
    marks = need.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()  # at most _MOST_BITS bits
    flat = np.zeros(bits // 8 + (1 << 12), np.uint8)
    for r in marks:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        flat[(r["k"] - 1) * len(m) : r["k"] * len(m)] = m
    shared = docs.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pack = shared.value, zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            at = pdf["at"].to_numpy()
            texts = pdf.loc[(held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1, "text"].tolist()
            if texts:
                h, chk = zip(*classify(texts), strict=True)
                yield pd.DataFrame({"h": h, "chk": chk, "z": [pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts]})

    at = F.pmod(F.xxhash64("rk"), F.lit(bits)).alias("at")
    got = row_key(docs).where(F.col("text").isNotNull()).select(at, "text").mapInPandas(run, "h long, chk long, z binary")
    return name_classes(got, clashes).join(need.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("z").alias("z"))
