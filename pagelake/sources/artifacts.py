"""A store of content-addressed bodies that can be written to again and again.

Two tables under one folder, both dealt out by the first byte of the digest: `bodies` has each digest once,
`seen` has a row for each digest and moment at which it was stored. A body that is there already is not
written again, nor is a moment. What was last seen longer ago than the time to live goes, partition by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.tables import delete

BODIES = "digest string, size long, mime string, body binary, prefix string"
SEEN = "digest string, seen_at timestamp, name string, prefix string"
#: Bodies up to this size are handed out inline.
INLINE = 256 << 10


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; one that nobody has written to is empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _append(df: DataFrame, path: str) -> None:
    """Large prefixes are split over several files, small ones stay one."""
    df.hint("rebalance", "prefix").write.partitionBy("prefix").mode("append").parquet(path)


def put(df: DataFrame, path: str, seen_at: Column, mime: str = "text/plain") -> None:
    """Store df(name, body); null bodies are none. Equal bodies are one, under the least name; storing the same at the same moment changes nothing.

    Only the digests of the store are read, never its bodies.
    """
    spark = df.sparkSession
    raw = F.col("body").cast("binary")
    df = df.where(F.col("body").isNotNull()).select(F.col("name").cast("string").alias("name"), raw.alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("prefix", F.substring("digest", 1, 2))
    have = _read(spark, f"{path}/bodies", BODIES).select("prefix", "digest")
    new = df.join(have, ["prefix", "digest"], "left_anti").groupBy("prefix", "digest").agg(F.any_value("body").alias("body"))
    _append(new.select("digest", F.octet_length("body").cast("long").alias("size"), F.lit(mime).alias("mime"), "body", "prefix"), f"{path}/bodies")
    moments = df.groupBy("prefix", "digest").agg(F.min("name").alias("name")).withColumn("seen_at", seen_at.cast("timestamp"))
    before = _read(spark, f"{path}/seen", SEEN).select("prefix", "digest", "seen_at")
    _append(moments.join(before, ["prefix", "digest", "seen_at"], "left_anti").select("digest", "seen_at", "name", "prefix"), f"{path}/seen")


def last_seen(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, digest, name, times, seen_at): the name under which a body was stored first, how often, and when last."""
    return _read(spark, f"{path}/seen", SEEN).groupBy("prefix", "digest").agg(F.min_by("name", F.struct("seen_at", "name")).alias("name"), F.count("*").alias("times"), F.max("seen_at").alias("seen_at"))


def expires_at(seen_at: Column, ttl_seconds: int) -> Column:
    """The moment after which a body is no longer kept."""
    return F.timestamp_add("SECOND", F.lit(ttl_seconds), seen_at)


def get(spark: SparkSession, path: str) -> DataFrame:
    """(digest, name, mime, size, times, seen_at, inline): what is there; larger bodies are left where they are."""
    bodies = _read(spark, f"{path}/bodies", BODIES)
    out = bodies.join(last_seen(spark, path), ["prefix", "digest"])
    inline = F.when(F.col("size") <= INLINE, F.replace(F.base64("body"), F.lit("\r\n"), F.lit("")))
    return out.select(F.concat(F.lit("sha256:"), "digest").alias("digest"), "name", "mime", "size", "times", "seen_at", inline.alias("inline"))


def expire(spark: SparkSession, path: str, now: Column, ttl_seconds: int) -> int:
    """Drop what was last seen longer ago than the time to live; the number of bodies that went.

    Only partitions that lose something are written anew, from what stays of them; one that loses all goes as a
    folder. There are 256 prefixes, so their list is small.
    """
    seen = last_seen(spark, path).withColumn("dead", expires_at(F.col("seen_at"), ttl_seconds) < now.cast("timestamp"))
    lost = {r.prefix: (r.dead, r.n) for r in seen.groupBy("prefix").agg(F.count_if("dead").alias("dead"), F.count("*").alias("n")).where("dead > 0").collect()}
    some = [p for p, (dead, n) in lost.items() if dead < n]
    if some:
        alive = seen.where(~F.col("dead") & F.col("prefix").isin(some)).select("prefix", "digest")
        for name, schema in (("bodies", BODIES), ("seen", SEEN)):  # the times decide, so they go last
            rows = _read(spark, f"{path}/{name}", schema).where(F.col("prefix").isin(some)).join(alive, ["prefix", "digest"], "left_semi")
            columns = [f.name for f in spark.createDataFrame([], schema).schema]
            rows.select(columns).hint("rebalance", "prefix").write.partitionBy("prefix").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")
    for p in lost:
        if p not in some:
            for name in ("bodies", "seen"):
                delete(spark, f"{path}/{name}/prefix={p}")
    return sum(dead for dead, _ in lost.values())
