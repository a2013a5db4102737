"""The store of bodies: written twice, expired, and what is in it."""

import os

from pyspark.sql import functions as F

from pagelake.sources import artifacts as A


def rows(spark, path):
    return sorted((r.digest[7:13], r.name, r.size, r.times) for r in A.get(spark, path).collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_store(spark, tmp_path):
    """Equal bodies, nulls, empty and long ones; the same again, the same later; expiry of some and of all."""
    path, at = f"file://{tmp_path}/s", lambda t: F.lit(f"2024-01-01 {t}").cast("timestamp")
    bodies = [("b", "one"), ("a", "one"), ("c", ""), ("d", None), ("e", "x" * 400_000), *((f"n{i}", f"body {i}") for i in range(300))]
    df = spark.createDataFrame(bodies, "name string, body string")
    A.put(df, path, at("00:00:00"))
    first, written = rows(spark, path), files(tmp_path)
    assert len(first) == 303 and ("7692c3", "a", 3, 1) in first and ("e3b0c4", "c", 0, 1) in first
    big = A.get(spark, path).where("size = 400000").first()
    assert big.inline is None and A.get(spark, path).where("size = 3").first().inline == "b25l"
    A.put(df, path, at("00:00:00"))
    assert rows(spark, path) == first and files(tmp_path) == written  # nothing was written again
    A.put(df.where("name IN ('b', 'n7')"), path, at("01:00:00"))
    assert {r[1]: r[3] for r in rows(spark, path) if r[3] > 1} == {"a": 2, "n7": 2} and len(rows(spark, path)) == 303
    assert A.expire(spark, path, at("00:30:00"), 3600) == 0 and len(rows(spark, path)) == 303
    assert A.expire(spark, path, at("01:00:01"), 3600) == 301
    assert [r[1] for r in rows(spark, path)] == ["a", "n7"] or sorted(r[1] for r in rows(spark, path)) == ["a", "n7"]
    A.put(df, path, at("02:00:00"))
    assert len(rows(spark, path)) == 303
    assert A.expire(spark, path, at("09:00:00"), 3600) == 303 and rows(spark, path) == []
    A.put(df.limit(0), path, at("09:00:00"))
    assert rows(spark, path) == []


def test_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert A.get(spark, path).isEmpty() and A.expire(spark, path, F.current_timestamp(), 1) == 0


def test_bodies_are_not_read_to_store(spark, tmp_path):
    """The scan of the store that the new bodies are held against has digests only."""
    path = f"file://{tmp_path}/s"
    df = spark.createDataFrame([("a", "one")], "name string, body string")
    A.put(df, path, F.lit("2024-01-01"))
    plan = df.withColumn("digest", F.sha2("body", 256)).join(A._read(spark, f"{path}/bodies", A.BODIES).select("prefix", "digest"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<digest:string>" in plan
