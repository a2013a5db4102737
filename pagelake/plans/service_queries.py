"""The remaining services, over pages, documents and small recorded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import services as V
from pagelake.operators import site as S
from pagelake.sources import artifacts as A
from pagelake.sources.tables import scratch_folder

from .fixtures import expected
from .page_queries import _F, PARAGRAPHS, _prepared
from .page_queries import geo_score as _score


def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.first_paragraph(_prepared(spark, sf_dir, "paragraphs")).where("lead IS NOT NULL")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.artifacts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


#: When the documents are stored, and for how long they are kept, in seconds.
_STORED, _KEPT = "2024-01-01 00:00:00", 3600


def artifact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored, stored again at the same moment, a third of them an hour later; then what has expired by that time goes."""
    folder, docs = scratch_folder(spark, "artifacts"), spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("name"), F.col("text").alias("body"))
    first = F.lit(_STORED).cast("timestamp")
    for rows, at in ((docs, first), (docs, first), (docs.where("name % 3 = 0"), A.expires_at(first, _KEPT))):
        A.put(rows, folder, at)
    A.expire(spark, folder, A.expires_at(first, _KEPT + 1), _KEPT)
    return A.get(spark, folder).select("digest", "name", "size", "times", F.unix_timestamp("seen_at").alias("seen_at"), F.sha2("inline", 256).alias("inline"))


def score_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.invariants(_score(spark, sf_dir))


def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of parts and the suppliers that they are bought from: suppliers lead nowhere."""
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return V.graph_findings(S.degrees(S.graph_edges(e)))


QUERIES = {f.__name__: f for f in (first_paragraph, artifacts, artifact_store, score_invariants, graph_findings)}
ORACLE_SQL = {
    "first_paragraph": f"WITH {_F}, p AS (SELECT page_id, {PARAGRAPHS} AS p FROM f) SELECT page_id, p[1] AS lead, CAST(len(string_split(p[1], ' ')) AS BIGINT) AS words FROM p WHERE len(p) > 0",
    "artifacts": "SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS uses, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS size, CASE WHEN octet_length(encode(any_value(text))) <= 262144 THEN to_base64(encode(any_value(text))) END AS inline FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "artifact_store": f"WITH d AS (SELECT sha256(text) AS h, min(CAST(doc_id AS VARCHAR)) AS name, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0) "
    f"SELECT 'sha256:' || h AS digest, name, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(2 AS BIGINT) AS times, CAST(epoch(TIMESTAMP '{_STORED}') AS BIGINT) + {_KEPT} AS seen_at, sha256(to_base64(encode(text))) AS inline FROM d SEMI JOIN k USING (h)",
    "score_invariants": expected("in_range boolean, within_possible boolean, one_a_page boolean", [(True, True, True)]),
    "graph_findings": "SELECT 'graph.unlinked' AS code, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'graph.dead_ends', count(DISTINCT l_suppkey) FROM lineitem",
}
