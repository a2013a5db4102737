"""The streaming operators run over a bounded table: what a stream of the same rows ends with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake import streaming as R
from pagelake.sources.tables import scratch_folder
from pagelake.streaming import changes as W

from .page_queries import DEFECTS, damaged

#: The checks that the change feed over the pages follows.
FOLLOWED = ("indexability", "canonical", "description", "schema", "social", "hreflang", "forms")


def events_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a feed says of three captures of all pages: as they are, damaged, and as they are again; the stream ends after each."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html")
    folder = scratch_folder(spark, "changes")
    for i, rows in enumerate((pages, damaged(pages), pages), 1):
        rows.withColumn("capture", F.lit(i).cast("long")).write.mode("append").parquet(f"{folder}/in")
        W.wait(W.follow(W.change_feed(spark, f"{folder}/in", *FOLLOWED), f"{folder}/out", f"{folder}/check"))
    out = spark.read.schema(W.CHANGES).parquet(f"{folder}/out")
    return out.select(F.substring_index("url", "#", -1).cast("long").alias("page_id"), "capture", "code", "change")


QUERIES = {f.__name__: f for f in (events_windowed, user_sessions, change_feed)}
ORACLE_SQL = {
    "events_windowed": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), "
    "s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}

# what all pages lack, and where the damage makes up for it
_LACKING = {"canonical.missing": "page_id % 5 = 1", "description.empty": "page_id % 5 = 1", "schema.missing": "page_id % 5 IN (2, 3)", "social.no_opengraph": "page_id % 5 = 3"}
_PUT_IN = [(code, f"page_id % {m} = {r}") for m, r, _, _, found in DEFECTS for code, _ in found if code.split(".")[0] in ("robots", "canonical", "description", "schema", "social", "hreflang", "form")]
ORACLE_SQL["change_feed"] = " UNION ALL ".join(
    [f"SELECT page_id, CAST(1 AS BIGINT) AS capture, '{c}' AS code, 'introduced' AS change FROM pages" for c in _LACKING]
    + [f"SELECT page_id, CAST({n} AS BIGINT), '{c}', '{change}' FROM pages WHERE {w}" for c, w in _LACKING.items() for n, change in ((2, "fixed"), (3, "introduced"))]
    + [f"SELECT page_id, CAST({n} AS BIGINT), '{c}', '{change}' FROM pages WHERE {w}" for c, w in _PUT_IN for n, change in ((2, "introduced"), (3, "fixed"))]
)
