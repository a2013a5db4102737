"""Sites: link graph over events, and cross-page checks, robots and sitemaps over small crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import audits as A
from pagelake.operators import chunks as K
from pagelake.operators import site as S
from pagelake.sources.tables import cut

ROUNDS, LEVELS = S.ROUNDS, S.CRAWL_DEPTH


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between users: who acts after whom on the same day."""
    return S.followers(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], F.to_date("ts"))


_LINKS = "k AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM k WHERE dst IS NOT NULL AND src <> dst)"


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.graph_edges(_links(spark, sf_dir))


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.degrees(S.graph_edges(_links(spark, sf_dir)))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pagerank(_links(spark, sf_dir))


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of users reached from the least one over all links, down to a crawl's depth limit."""
    e = cut(S.graph_edges(_links(spark, sf_dir)))
    start = e.agg(F.min("src")).first()[0] or 0
    return S.bfs(e, start, S.CRAWL_DEPTH)


BUDGET = 150


def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk of crawl_bfs without the users that every tenth number refuses, and up to a budget of users."""
    e = cut(S.graph_edges(_links(spark, sf_dir)))
    start = e.agg(F.min("src")).first()[0] or 0
    refused = e.select(F.col("dst").alias("node")).distinct().where("node % 10 = 0")
    return S.bfs(e, start, S.CRAWL_DEPTH, refused, BUDGET)


def most_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the highest rank."""
    return S.most_linked(_links(spark, sf_dir))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from parts, which nothing links to, to their suppliers, which lead nowhere."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


_TRADE = "e AS MATERIALIZED (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem)"


def least_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.least_linked(_trade(spark, sf_dir))


def dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dead_ends(_trade(spark, sf_dir))


def pages_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all pages; page_chunks has the odd cases."""
    return K.page_chunks(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no finished order points to."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("url"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.lit("o").alias("src"), F.col("o_custkey").cast("string").alias("dst"))
    return S.orphans(c, o, "0").select(F.col("url").cast("long").alias("custkey"))


#: Orders of even years are one audit, those of odd years the other.
EVEN, ODD, _CODES = 0, 1, 700


def _audit(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.year("o_orderdate") % 2 == half)
    sev = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "high").otherwise("low")
    return o.select(F.concat("o_orderstatus", F.lit("."), (F.col("o_custkey") % _CODES).cast("string")).alias("code"), sev.alias("severity"))


def _audit_sql(half: int) -> str:
    return f"SELECT o_orderstatus || '.' || o_custkey % {_CODES} AS code, CASE o_orderstatus WHEN 'F' THEN 8 WHEN 'O' THEN 4 ELSE 1 END AS w FROM orders WHERE year(o_orderdate) % 2 = {half}"


def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit_diff(_audit(spark, sf_dir, EVEN), _audit(spark, sf_dir, ODD))


def compete_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _audit(spark, sf_dir, EVEN).select(F.lit("ours").alias("side"), "code").unionAll(_audit(spark, sf_dir, ODD).select(F.lit("theirs").alias("side"), "code"))
    return A.compare(f)


def fault_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _audit(spark, sf_dir, EVEN).withColumn("audit", F.lit("even")).unionAll(_audit(spark, sf_dir, ODD).withColumn("audit", F.lit("odd")))
    return A.fault_weight(f)


QUERIES = {f.__name__: f for f in (graph_edges, graph_degrees, pagerank, crawl_bfs, crawl_budget, most_linked, least_linked, dead_ends, pages_chunked, orphan_pages, audit_diff, compete_compare, fault_weight)}


def _pagerank_sql(links: str = _LINKS) -> str:
    rounds = ", ".join(
        f"r{i} AS MATERIALIZED (SELECT n.node, n.outbound, (1 - {S.DAMPING}) / t.n + {S.DAMPING} * (SELECT coalesce(sum(score) FILTER (outbound = 0), 0) FROM r{i - 1}) / t.n + {S.DAMPING} * coalesce(g.got, 0) AS score "
        f"FROM n CROSS JOIN t LEFT JOIN (SELECT e.dst, sum(r.score / r.outbound) AS got FROM e JOIN r{i - 1} r ON e.src = r.node GROUP BY e.dst) g ON g.dst = n.node)"
        for i in range(1, ROUNDS + 1)
    )
    return (
        f"WITH {links}, n AS MATERIALIZED (SELECT node, count(DISTINCT o) AS outbound FROM (SELECT src AS node, dst AS o FROM e UNION ALL SELECT dst, NULL FROM e) GROUP BY node), t AS (SELECT count(*)::DOUBLE AS n FROM n), "
        f"r0 AS (SELECT node, outbound, 1 / t.n AS score FROM n, t), {rounds} SELECT node, round(score, 5) AS score FROM r{ROUNDS}"
    )


def _ranked_sql(which: str, links: str = _LINKS) -> str:
    degrees = f"WITH {links} SELECT node, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY node"
    return f"SELECT d.node, inbound, outbound, score FROM ({degrees}) d JOIN ({_pagerank_sql(links)}) p ON d.node = p.node WHERE {which} ORDER BY score DESC, node LIMIT {S.RANKED}"


_B = ", ".join(f"b{i} AS MATERIALIZED (SELECT DISTINCT e.dst AS node FROM e JOIN b{i - 1} b ON e.src = b.node)" for i in range(1, LEVELS + 1))
_S = ", ".join(
    f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT node, {i} AS depth FROM (SELECT DISTINCT e.dst AS node FROM e JOIN s{i - 1} x ON e.src = x.node WHERE x.depth = {i - 1} AND e.dst % 10 <> 0 AND e.dst NOT IN (SELECT node FROM s{i - 1}) ORDER BY 1 LIMIT (SELECT {BUDGET} - count(*) FROM s{i - 1})))"
    for i in range(1, LEVELS + 1)
)
ORACLE_SQL = {
    "crawl_budget": f"WITH {_LINKS}, s0 AS (SELECT coalesce(min(src), 0) AS node, 0 AS depth FROM e), {_S} SELECT node, CAST(depth AS INTEGER) AS depth FROM s{LEVELS}",
    "graph_edges": f"WITH {_LINKS} SELECT * FROM e",
    "graph_degrees": f"WITH {_LINKS} SELECT node, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY node",
    "most_linked": _ranked_sql("true"), "least_linked": _ranked_sql("inbound = 0", _TRADE), "dead_ends": _ranked_sql("outbound = 0", _TRADE),
    "pagerank": _pagerank_sql(),
    "crawl_bfs": f"WITH {_LINKS}, b0 AS (SELECT coalesce(min(src), 0) AS node FROM e), {_B} SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (" + " UNION ALL ".join(f"SELECT node, {i} AS depth FROM b{i}" for i in range(LEVELS + 1)) + ") GROUP BY node",
    "orphan_pages": "SELECT c_custkey AS custkey FROM customer WHERE c_custkey <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "audit_diff": f"WITH b AS (SELECT code, max(w) AS b FROM ({_audit_sql(EVEN)}) GROUP BY code), a AS (SELECT code, max(w) AS a FROM ({_audit_sql(ODD)}) GROUP BY code) SELECT coalesce(b.code, a.code) AS code, CASE WHEN a IS NULL THEN 'fixed' WHEN b IS NULL THEN 'introduced' ELSE 'remaining' END AS change, CAST(b AS BIGINT) AS before, CAST(a AS BIGINT) AS after FROM b FULL JOIN a ON b.code = a.code",
    "compete_compare": f"WITH o AS (SELECT DISTINCT code FROM ({_audit_sql(EVEN)})), t AS (SELECT DISTINCT code FROM ({_audit_sql(ODD)})) SELECT coalesce(o.code, t.code) AS code, CASE WHEN t.code IS NULL THEN 'ours' WHEN o.code IS NULL THEN 'theirs' ELSE 'both' END AS where_found FROM o FULL JOIN t ON o.code = t.code",
    "fault_weight": " UNION ALL ".join(f"SELECT '{n}' AS audit, CAST((SELECT sum(w) FROM ({_audit_sql(y)})) AS BIGINT) AS all_findings, CAST((SELECT sum(w) FROM (SELECT code, max(w) AS w FROM ({_audit_sql(y)}) GROUP BY code)) AS BIGINT) AS by_code" for n, y in (("even", EVEN), ("odd", ODD))),
}
