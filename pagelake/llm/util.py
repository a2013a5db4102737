"""Shared pieces of the training-data operators: word rule, scratch tables, compression."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more characters that are neither a space nor one of tab .. carriage return.
WORD_RX = r"[^\x20\x09-\x0D]+"


#: What a Python worker keeps between tasks: a call of each lets it go.
_caches: list[Callable[[], None]] = []


def keep_between_tasks(let_go: Callable[[], None]) -> None:
    """Notes a cache of this worker, for drop_caches."""
    _caches.append(let_go)


def drop_caches() -> None:
    """Lets go of what other operators keep in this worker; called where an operator needs the memory itself."""
    for let_go in _caches:
        let_go()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)  # what was freed goes back to the system; else the worker keeps most of it


def words_of(text: str | None) -> list[bytes]:
    """Words by WORD_RX, as UTF-8. bytes.split() splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a session on one machine may do without that setting; it gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='pagelake-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of the scratch tables made within the current scope, if there is one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the paths of the scratch tables made inside."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def kept_alone(spark: SparkSession, body: Callable[[], DataFrame], name: str) -> DataFrame:
    """body() as a scratch table; the scratch tables it was made from are deleted."""
    with scratch_scope() as made:
        out = body()
        path = f"{shared_dir(spark)}/pagelake-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
    delete_paths(spark, made)
    return spark.read.schema(out.schema).parquet(path)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for f in paths:
        p = jvm.org.apache.hadoop.fs.Path(f)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pagelake-{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)  # what is left goes with the driver
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    delete_paths(df.sparkSession, sorted({x.rpartition("/")[0] for x in df.inputFiles() if "/pagelake-" in x}))


#: Bits of a mark table: 16 for each key, within these bounds. Beyond the upper one more rows than meant may be marked, none is missed.
LEAST_MARKS, MOST_MARKS = 1 << 16, 1 << 27


def marked(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with a column `name`: false where the key is surely not among keys(key), true where it may be.

    A bitmap of the keys' hashes, MOST_MARKS bits at most, is broadcast; all of it is DataFrame functions.
    """
    own = keys.columns[0]
    bits = min(max(1 << (16 * keys.count()).bit_length(), LEAST_MARKS), MOST_MARKS)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # noqa: E731  buckets begin at 1
    bucket, marks, place = free(df, "mark_bucket", "mark_bits", "mark_place")
    table = keys.groupBy(F.bitmap_bucket_number(bit(own)).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(own))).alias(marks))
    table = scratch(table, "marks")
    rows = df.withColumn(place, F.bitmap_bit_position(bit(key))).join(F.broadcast(table), F.bitmap_bucket_number(bit(key)) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(marks, (F.floor(F.col(place) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("getbit", byte, (F.col(place) % 8).cast("int")) == 1
    return rows.withColumn(name, F.coalesce(hit, F.lit(False))).drop(bucket, marks, place)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores after it as docs has columns of that name."""
    have, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in have:
            n += "_"
        out.append(n)
        have.add(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
