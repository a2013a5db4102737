"""All queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, crawl_queries, page_queries, recorded_queries, report_queries, service_queries, site_queries, sitemap_queries, spark_queries, stream_queries, text_queries

_MODULES = (answer_queries, crawl_queries, page_queries, text_queries, site_queries, sitemap_queries, spark_queries, recorded_queries, stream_queries, service_queries, report_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding about every page."""
    return page_queries.findings_all(spark, sf_dir)
