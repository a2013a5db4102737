"""Cutting long lineages, and reading what was captured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine may do without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='pagelake-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def goes_with_driver(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the driver ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes with the driver."""
    return goes_with_driver(spark, f"{shared_folder(spark)}/pagelake-{name}-{uuid.uuid4().hex}")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df, which keeps its partitioning; the files go with the driver."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
        goes_with_driver(spark, sc.getCheckpointDir())
    return df.checkpoint()


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
