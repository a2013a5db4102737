"""Lists of crawl indexes as they stood at a moment: the newest list that could be read, fresh or stale.

A source is asked again and again; what it answers may be broken or empty. For each moment at which somebody
wants the list, it is the newest good answer before it that counts: `fresh` within the time to live, `stale`
beyond it, `unavailable` where there never was one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Indexes of a list that are looked into, and seconds for which a list is fresh.
MOST, FRESH_SECONDS = 8, 86_400
LIST = "array<struct<id: string, api: string>>"
CAPTURE = "url string, status string, mime string, timestamp string"


def index_lines(lines: DataFrame, ddl: str = CAPTURE) -> DataFrame:
    """lines(key, line) of a capture index, a JSON object each -> (key, parsed, malformed): blank lines are none, malformed ones are kept apart."""
    df = lines.where(F.trim("line") != "").withColumn("x", F.from_json("line", f"{ddl}, malformed string", {"columnNameOfCorruptRecord": "malformed"}))
    bad = F.col("x.malformed").isNotNull() | F.col("x").isNull()
    names = [c.strip().split()[0] for c in ddl.split(",")]
    return df.select("key", F.when(~bad, F.struct(*(F.col(f"x.{n}").alias(n) for n in names))).alias("parsed"), bad.alias("malformed"))


def capture_summary(lines: DataFrame) -> DataFrame:
    """lines(key, line) -> (key, captures, status_2xx, html, urls, malformed)."""
    x = index_lines(lines)
    ok = ~F.col("malformed")
    return x.groupBy("key").agg(
        F.count_if(ok).alias("captures"), F.count_if(ok & F.coalesce(F.col("parsed.status").startswith("2"), F.lit(False))).alias("status_2xx"),
        F.count_if(ok & F.coalesce(F.contains("parsed.mime", F.lit("html")), F.lit(False))).alias("html"), F.count_distinct("parsed.url").alias("urls"), F.count_if("malformed").alias("malformed"),
    )


def index_lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(key, line) of captured index files; the file is the key."""
    return spark.read.text(path).select(F.input_file_name().alias("key"), F.col("value").alias("line"))


def good_list(body: Column) -> Column:
    """The indexes of an answer, newest first, or null if it is no JSON list or an empty one; the first MOST count."""
    got = F.from_json(body, LIST)
    known = F.filter(got, lambda x: x["id"].isNotNull())
    newest = F.reverse(F.array_sort(known))
    return F.when(F.ltrim(body).startswith("[") & (F.size(known) > 0), F.slice(newest, 1, MOST))


def lists_as_of(fetches: DataFrame, asked: DataFrame, fresh_seconds: int = FRESH_SECONDS, bucket_seconds: int = 3600) -> DataFrame:
    """fetches(source, at, body), asked(id, source, at) -> (id, source, at, fetched_at, indexes, state).

    The newest good answer at or before `at`; of several at the same moment the greatest list. Time is cut into buckets: within
    a bucket rows are ordered by one task, and what a bucket begins with comes from a small table with a row for
    each source and bucket, so a source that is asked all the time is spread over many tasks.
    """
    bucket = lambda t: F.floor(F.unix_timestamp(t) / bucket_seconds)
    good = fetches.select("source", "at", good_list(F.col("body")).alias("indexes")).where(F.col("indexes").isNotNull()).withColumn("bucket", bucket(F.col("at")))
    asked = asked.select("id", "source", "at", bucket(F.col("at")).alias("bucket"))
    answer = F.struct(F.col("at").alias("fetched_at"), "indexes")
    # the last good answer of each bucket, and what stood before each bucket that somebody asks in
    ends = good.groupBy("source", "bucket").agg(F.max(answer).alias("last"))
    marks = ends.unionByName(asked.select("source", "bucket").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType))).groupBy("source", "bucket").agg(F.max("last").alias("last"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = marks.select("source", "bucket", F.last("last", ignorenulls=True).over(before).alias("standing"))
    rows = asked.select("id", "source", "at", "bucket", F.lit(1).alias("kind"), F.lit(None).cast(ends.schema["last"].dataType).alias("own")).unionByName(
        good.select(F.lit(None).cast(asked.schema["id"].dataType).alias("id"), "source", "at", "bucket", F.lit(0).alias("kind"), answer.alias("own")))
    within = Window.partitionBy("source", "bucket").orderBy("at", "kind", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = rows.withColumn("seen", F.last("own", ignorenulls=True).over(within)).where("kind = 1").join(begins, ["source", "bucket"], "left")
    known = known.withColumn("got", F.coalesce("seen", "standing"))
    age = F.unix_timestamp("at") - F.unix_timestamp("got.fetched_at")
    state = F.when(F.col("got").isNull(), "unavailable").when(age <= fresh_seconds, "fresh").otherwise("stale")
    return known.select("id", "source", "at", F.col("got.fetched_at").alias("fetched_at"), F.col("got.indexes").alias("indexes"), state.alias("state"))
