"""Table functions in SQL, observed invariants, differences of long texts, lists as of a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import table_functions as L
from pagelake.operators import geo_score as G
from pagelake.operators import index_lists as I
from pagelake.operators import observed as O
from pagelake.operators import page_checks as C
from pagelake.operators import site as S
from pagelake.operators import text_difference as D

from .page_queries import DEFECTS, _pages, _prepared, damaged
from .report_queries import content_charts
from .site_queries import _CODES, _links, audit_diff
from .text_queries import _SH, _W, _t


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all pages, by the table function."""
    L.register(spark)
    return spark.sql("SELECT page_id, c.* FROM {pages} p, LATERAL chunks(p.html) c", pages=_pages(spark, sf_dir))


def jsonld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed nodes of the damaged pages' structured data, and the blocks that do not parse, by the table function."""
    L.register(spark)
    return spark.sql("SELECT page_id, j.block, j.ord, j.type, j.node, j.error IS NOT NULL AS broken FROM {pages} p, LATERAL jsonld(p.html) j", pages=damaged(_pages(spark, sf_dir)))


def service_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of five services' results over the tables, seen while they are made; a row a flag."""
    facts, links = _prepared(spark, sf_dir), _links(spark, sf_dir)
    rows = O.settled(O.ordered_findings(facts), "page.audit", O.page_audit()) + O.settled(G.geo_score(G.geo_signals(facts)), "geo.score", O.geo_score()) + O.settled(S.ranked_exactly(links), "site.graph", O.site_graph())
    rows += O.settled(audit_diff(spark, sf_dir), "audit.diff", O.audit_diff()) + O.settled(content_charts(spark, sf_dir), "content.charts", O.content_charts())
    return spark.createDataFrame(rows, "service string, check string, passed boolean, rows long")


def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each damaged page's codes of the checks that the damage speaks to, the worst first."""
    f = O.ordered_findings(C.prepared(C.captured(damaged(_pages(spark, sf_dir)))), "indexability", "forms", "schema", "hreflang")
    return f.select("page_id", F.array_join(F.transform("findings", lambda x: F.concat(x["severity"], F.lit(":"), x["code"])), ",").alias("findings"))


def shingle_diff_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it, by runs of words that are rows of their own."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("after"))
    pairs = d.join(d.select((F.col("id") + 1).alias("id"), F.col("after").alias("before")), "id")
    return D.only_share(pairs).withColumnRenamed("id", "doc_id")


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views as answers of five sources; every third is broken, cut off, empty, or no list."""
    n = F.col("event_id")
    body = F.concat(F.lit('[{"id":"CC-0","api":"v"},{"id":"CC-'), n.cast("string"), F.lit('","api":"u"}]'))
    body = F.when(n % 3 > 0, body).when(n % 4 == 0, F.substring(body, 1, 20)).when(n % 4 == 1, "[]").when(n % 4 == 2, '{"id":"x"}')
    return _t(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select((F.col("user_id") % 5).alias("source"), F.col("ts").cast("timestamp").alias("at"), body.alias("body"))


def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that stood when an error came up, for each error."""
    asked = _t(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("source"), F.col("ts").cast("timestamp").alias("at"))
    out = I.lists_as_of(_fetches(spark, sf_dir), asked, FRESH)
    return out.select("id", "source", F.array_join(F.transform("indexes", lambda x: x["id"]), ",").alias("indexes"), "state")


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a capture index, by user; some are blank, some malformed."""
    n = F.col("event_id")
    line = F.to_json(F.struct(F.concat(F.lit("https://a.test/"), (n % 50).cast("string")).alias("url"), F.when(n % 5 == 0, "404").otherwise("200").alias("status"), F.when(n % 4 != 1, "text/html").alias("mime"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp")))
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), n.alias("n"), line.alias("line"))
    return I.capture_summary(e.select("key", F.when(F.col("n") % 11 == 0, "  ").when(F.col("n") % 7 == 0, F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line")).alias("line")))


#: Seconds for which a list of the test's sources is fresh.
FRESH = 900
QUERIES = {f.__name__: f for f in (page_chunks, jsonld_nodes, service_invariants, findings_ordered, shingle_diff_long, index_lists, capture_lines)}
_CHECKS = {
    "page.audit": (("page_was_fetched", "findings_have_codes", "severities_known", "findings_ordered_by_severity"), "(SELECT count(*) FROM pages)"), "geo.score": (("score_in_range", "score_within_possible", "band_known"), "(SELECT count(DISTINCT page_id) FROM pages)"),
    "site.graph": (("ranks_not_negative", "ranks_sum_to_one", "nodes_have_links"), "(SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e))"),
    "audit.diff": (("change_known", "sides_agree_with_change", "codes_named"), f"(SELECT count(DISTINCT o_orderstatus || '.' || o_custkey % {_CODES}) FROM orders)"),
    "content.charts": (("chartable_are_detected", "table_follows_figures", "no_table_without_figures"), "(SELECT count(*) FROM orders)"),
}
_EVENTS = "k AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT DISTINCT src, dst FROM k WHERE dst IS NOT NULL AND src <> dst)"
ORACLE_SQL = {
    "jsonld_nodes": """SELECT page_id, 0 AS block, 0 AS ord, 'Product' AS type, '{"@type":"Product"}' AS node, false AS broken FROM pages WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 1, -1, NULL, NULL, true FROM pages WHERE page_id % 5 = 2
    UNION ALL SELECT page_id, 0, 0, 'BreadcrumbList', '{"@type":"BreadcrumbList","itemListElement":[1]}', false FROM pages WHERE page_id % 5 = 3""",
    "service_invariants": f"WITH {_EVENTS} " + " UNION ALL ".join(f"SELECT '{s}' AS service, '{c}' AS \"check\", true AS passed, CAST({n} AS BIGINT) AS rows" for s, (checks, n) in _CHECKS.items() for c in checks),
    "shingle_diff_long": f"WITH t AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT doc_id, {_SH} AS s FROM t) SELECT b.doc_id, round(len(list_filter(b.s, lambda x: NOT list_contains(a.s, x))) / greatest(len(b.s), 1), 3) AS only_share, CAST(len(b.s) AS BIGINT) AS runs FROM s b JOIN s a ON a.doc_id + 1 = b.doc_id",
    "index_lists": f"""WITH g AS (SELECT user_id % 5 AS source, ts AS at, CASE WHEN event_id = 0 THEN 'CC-0,CC-0' ELSE 'CC-' || event_id || ',CC-0' END AS indexes FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 > 0),
    a AS (SELECT event_id AS id, user_id % 5 AS source, ts AS at FROM events WHERE event_type = 'error')
    SELECT id, a.source, indexes, CASE WHEN indexes IS NULL THEN 'unavailable' WHEN epoch(date_trunc('second', a.at)) - epoch(date_trunc('second', g.at)) <= {FRESH} THEN 'fresh' ELSE 'stale' END AS state FROM a ASOF LEFT JOIN g ON a.source = g.source AND a.at >= g.at""",
    "capture_lines": "WITH l AS (SELECT user_id AS key, event_id AS n FROM events WHERE event_id % 11 <> 0) SELECT key, count(*) FILTER (n % 7 <> 0) AS captures, count(*) FILTER (n % 7 <> 0 AND n % 5 <> 0) AS status_2xx, count(*) FILTER (n % 7 <> 0 AND n % 4 <> 1) AS html, count(DISTINCT CASE WHEN n % 7 <> 0 THEN n % 50 END) AS urls, count(*) FILTER (n % 7 = 0) AS malformed FROM l GROUP BY key",
}
# the damage's findings, worst first; pages without structured data lack it
_PUT = [(m, r, code, sev) for m, r, _, _, found in DEFECTS for code, sev in found if code.split(".")[0] in ("robots", "form", "schema", "hreflang")]
_EACH = " UNION ALL ".join(f"SELECT page_id, '{code}' AS code, '{sev}' AS severity FROM pages WHERE page_id % {m} = {r}" for m, r, code, sev in _PUT) + " UNION ALL SELECT page_id, 'schema.missing', 'high' FROM pages WHERE page_id % 5 NOT IN (2, 3)"
ORACLE_SQL["findings_ordered"] = f"WITH f AS ({_EACH}) SELECT page_id, string_agg(severity || ':' || code, ',' ORDER BY list_position(['critical', 'high', 'low', 'info'], severity), code) AS findings FROM f GROUP BY page_id"
