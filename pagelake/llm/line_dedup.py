"""Removal of boilerplate lines that many distinct sites share.

Per line, told apart by 128 bits, a HyperLogLog sketch of the sites that carry the line is built with partial
aggregation and merged. Where the estimate is clearly under or over the threshold it decides; lines
near the threshold get an exact distinct count. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 10
LG_K = 8
#: Three relative standard errors of a sketch with 2^LG_K registers.
MARGIN = 3 * 1.04 / 2 ** (LG_K / 2)


def line_hashes(text: Column) -> Column:
    """The trimmed lines of a text, in order, as 128 bits: two hashes of different seeds; null for a blank line."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    return F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))))


def _lines(docs: DataFrame, *cols: Column) -> DataFrame:
    """A row a line; a line that a document repeats is there as often, which neither sketches nor distinct counts mind."""
    return docs.select(*cols, F.explode(line_hashes(F.col("text"))).alias("x")).where(F.col("x").isNotNull()).select("*", "x.h", "x.g").drop("x")


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g): hashes of the lines on at least `min_sites` distinct non-null sites."""
    lines = _lines(docs.where(F.col(site).isNotNull()), F.col(site).alias("site"))
    spread = (
        lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
        .select("h", "g", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - MARGIN) - 1)
    )
    near = F.col("sites") <= min_sites * (1 + MARGIN) + 1
    exact = (
        lines.join(spread.where(near).select("h", "g"), ["h", "g"], "left_semi")
        .groupBy("h", "g").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return spread.where(~near).select("h", "g").unionAll(exact.select("h", "g"))


def dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs(doc_id, text, <site>, ...) -> (doc_id, n_lines, n_removed, text without boilerplate lines).

    Lines are compared trimmed; blank lines are neither counted nor removed. Rows without a site are
    cleaned but do not count as one. A null text stays null with no lines. Repeated rows stay.
    """
    bad = boilerplate_lines(docs, site, min_sites)
    # only the few lines found are gathered: a document's list is as long as its own lines at most
    marks = (
        _lines(docs, F.col("doc_id").alias("mark_id")).join(bad, ["h", "g"]).groupBy("mark_id").agg(F.collect_set(F.struct("h", "g")).alias("gone"))
    )
    df = docs.select("doc_id", "text").join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")), "left")
    gone = F.coalesce("gone", F.array().cast("array<struct<h:bigint,g:bigint>>"))
    df = df.withColumn("hashes", line_hashes(F.col("text")))
    removed = F.transform("hashes", lambda h: F.coalesce(F.array_contains(gone, h), F.lit(False)))
    df = df.withColumn("removed", F.when(F.size(gone) > 0, removed))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.element_at("removed", i + 1))
    return df.select(
        "doc_id",
        F.coalesce(F.size(F.filter("hashes", lambda h: h.isNotNull())), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("removed", lambda x: x)), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def dedup_sql(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH l AS (
  SELECT doc_id, source, text, list_transform(string_split(text, chr(10)), lambda x: x) AS lines FROM documents),
e AS (SELECT DISTINCT source, trim(x) AS line FROM (SELECT source, unnest(lines) AS x FROM l) WHERE source IS NOT NULL),
bad AS (SELECT line FROM e WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
b AS (SELECT coalesce(list(line), []) AS bad FROM bad)
SELECT doc_id,
  CAST(coalesce(len(list_filter(lines, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(list_filter(lines, lambda x: list_contains(bad, trim(x)))), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(lines, lambda x: NOT list_contains(bad, trim(x))), chr(10)), '')) AS kept_sha256
FROM l, b"""
