"""Continuous versions of the audits, over streams of captured pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_findings(spark: SparkSession, folder: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Findings of pages as their files arrive in a folder; stateless, so it scales like the batch query."""
    from pagelake.operators import page_checks as C

    pages = spark.readStream.schema("page_id long, url string, html string").parquet(folder)
    return C.findings(C.prepared(C.captured(pages)), *prefixes)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; rows later than `late` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a longer pause than `gap`."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def write_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet, exactly once; stops when what is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
