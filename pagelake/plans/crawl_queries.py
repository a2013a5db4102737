"""Cross-page audit of the pages, put into one site: they link to each other, move, fail, and name each other as canonicals and alternates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import page_checks as C
from pagelake.operators import site as S

from .page_queries import _F, _pages

SITE, DEEPEST = "https://s.test/p/", 6
# what the n-th page is like; each condition holds for both engines
_BARE, _LOST, _MOVED, _LOOPS = "n % 15 = 8", "n % 11 = 5", "n % 13 = 4", "n % 13 = 9"
_CANONICAL, _NOINDEX, _FRENCH, _ENGLISH = "n % 5 = 1", "n % 6 = 2", "n % 4 = 2", "n % 8 = 3"
_SAME_TITLE, _DESCRIBED, _NOFOLLOW, _SECOND = "n % 12 = 7", "n % 9 IN (3, 6)", "n % 7 = 3", "n % 3 = 0"


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the pages as pages of one site, with a depth."""
    n = F.col("n")
    to = lambda k: F.concat(F.lit("/p/"), (n + k).cast("string"))
    put = lambda when, *parts: F.when(F.expr(when), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise("")
    head = F.concat(
        put(_CANONICAL, '<link rel="canonical" href="', to(1), '">'), put(_NOINDEX, '<meta name="robots" content="NoIndex">'), put(_FRENCH, '<link rel="alternate" hreflang="fr" href="', to(1), '">'),
        put(_ENGLISH, '<link rel="alternate" hreflang="en" href="', to(-1), '">'), put(_DESCRIBED, '<meta name="description" content="About ', (n % 2).cast("string"), '">'),
    )
    body = F.concat(F.lit("<body>"), F.lit('<a href="'), to(1), F.when(F.expr(_NOFOLLOW), '#x" rel="nofollow">next</a>').otherwise('">next</a>'), put(_SECOND, '<a rel="nofollow" href="', to(3), '">skip</a>'))
    html = F.replace(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), head)), F.lit("<body>"), body)
    html = F.when(F.expr(_SAME_TITLE), F.regexp_replace(html, "<title>[^<]*</title>", "<title>Same</title>")).otherwise(html)
    html = F.when(F.expr(_BARE), F.concat(F.lit("<html><head><title>Bare "), n.cast("string"), F.lit("</title></head><body><p>Same body.</p></body></html>"))).otherwise(html)
    own = F.concat(F.lit(SITE), n.cast("string"))
    p = _pages(spark, sf_dir).select("page_id", F.col("page_id").alias("n"), "html").withColumn("html", html).withColumn("url", own)
    facts = C.prepared(C.captured(p), ("metas", "canonicals", "titles", "descriptions", "hreflangs", "links", "body_text"))
    hop = lambda *urls: F.array(*(F.struct(u.alias("url")) for u in urls))
    n, url = F.col("page_id"), F.col("url")
    old = F.concat(url, F.lit("/old"))
    facts = facts.withColumn("n", n).withColumn("hops", F.when(F.expr(_MOVED), hop(old, F.concat(old, F.lit("er")), url)).when(F.expr(_LOOPS), hop(url, old, url)).otherwise(hop(url)))
    return facts.withColumn("status", F.when(F.expr(_LOST), 404).otherwise(200)).withColumn("ok", ~F.expr(_LOST)).withColumn("depth", n % 7)


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.crawl_pages(_site(spark, sf_dir))


def _over_pages(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_crawl(spark, sf_dir))


def _both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = _site(spark, sf_dir)
        return f(S.crawl_pages(facts), S.link_edges(facts, DEEPEST))

    return run


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


QUERIES = {
    "canonical_conflicts": _over_pages(S.canonical_conflicts), "hreflang_broken": _over_pages(S.hreflang_broken), "hreflang_return": _over_pages(S.hreflang_return), "redirect_chains": _over_pages(S.redirect_problems), "crawl_summary": _over_pages(S.crawl_summary),
    "dup_groups": _over_pages(lambda p: S.duplicate_groups(p, "title").withColumn("sample", _joined("sample"))), "follow_signals": _both(S.follow_signals), "broken_links": _both(lambda p, e: S.broken_links(p, e).withColumn("linked_from", _joined("linked_from"))),
    "crosspage_findings": _both(lambda p, e: S.crosspage_findings(p, e, f"{SITE}0")), "link_edges": lambda spark, sf_dir: S.link_edges(_site(spark, sf_dir), DEEPEST).where(f"startswith(dst, '{SITE}')"),
}
_U = lambda x: f"'{SITE}' || ({x})"
_C = f"""{_F}, c AS (SELECT page_id AS n, {_BARE} AS bare, NOT ({_LOST}) AS ok, NOT ({_BARE}) AND {_NOINDEX} AS noindex, NOT ({_BARE}) AND {_CANONICAL} AS named, {_MOVED} AS moved, {_LOOPS} AS loops, n % 7 AS depth,
  CASE WHEN {_BARE} THEN 'Bare ' || n WHEN {_SAME_TITLE} THEN 'Same' ELSE title END AS title, CASE WHEN NOT ({_BARE}) AND {_DESCRIBED} THEN 'About ' || n % 2 END AS description, CASE WHEN {_BARE} THEN 'Same body.' ELSE text || ({_SECOND}) END AS body FROM (SELECT *, page_id AS n FROM f)),
l AS (SELECT n AS src, n + 1 AS dst, {_NOFOLLOW} AS nofollow, depth < {DEEPEST} AS inbound FROM c WHERE ok AND NOT bare UNION ALL SELECT n, n + 3, true, depth < {DEEPEST} FROM c WHERE ok AND NOT bare AND {_SECOND}),
h AS (SELECT n AS src, n + 1 AS dst FROM c WHERE NOT bare AND {_FRENCH} UNION ALL SELECT n, n - 1 FROM c WHERE NOT bare AND {_ENGLISH}),
t AS (SELECT p.n AS src, q.n AS dst, CASE WHEN NOT q.ok THEN 'error' WHEN q.moved OR q.loops THEN 'redirect' WHEN q.named THEN 'noncanonical' WHEN q.noindex THEN 'nonindexable' END AS conflict FROM c p JOIN c q ON q.n = p.n + 1 WHERE p.named),
x AS (SELECT h.src, h.dst, q.ok, q.noindex, EXISTS (SELECT 1 FROM h b WHERE b.src = h.dst AND b.dst = h.src) AS back FROM h JOIN c q ON q.n = h.dst),
g AS (SELECT dst, bool_and(nofollow) AS lone, bool_or(nofollow) AS part, bool_or(inbound) AS linked FROM l GROUP BY dst)"""
_C = _C.replace("t AS (SELECT *, trim", "tt AS (SELECT *, trim").replace(" FROM t),\nr0", " FROM tt),\nr0")
_DUP = lambda col: f"(SELECT count(*) FROM (SELECT {col} FROM c WHERE ok AND NOT noindex AND coalesce({col}, '') <> '' GROUP BY {col} HAVING count(*) > 1))"
_COUNTS = {
    "site.duplicate_title": _DUP("title"), "site.duplicate_description": _DUP("description"), "site.duplicate_content": _DUP("body"), "site.orphan_pages": "(SELECT count(*) FROM c WHERE ok AND NOT noindex AND n <> 0 AND n NOT IN (SELECT dst FROM l WHERE inbound))",
    "site.too_deep": f"(SELECT count(*) FROM c WHERE ok AND NOT noindex AND depth > {S.MAX_DEPTH})", "site.redirect_chains": "(SELECT count(*) FROM c WHERE moved OR loops)", "site.redirect_loops": "(SELECT count(*) FROM c WHERE loops)",
    **{f"site.canonical_to_{k}": f"(SELECT count(*) FROM t WHERE conflict = '{k}')" for k in ("error", "redirect", "noncanonical", "nonindexable")}, "site.nofollow_to_indexable": "(SELECT count(*) FROM g JOIN c ON n = dst WHERE lone AND ok AND NOT noindex)",
    "site.mixed_follow_signals": "(SELECT count(*) FROM g WHERE part AND NOT lone)", "site.hreflang_no_return_link": "(SELECT count(*) FROM x WHERE ok AND NOT back)", "site.hreflang_to_error": "(SELECT count(*) FROM x WHERE NOT ok)",
    "site.hreflang_to_nonindexable": "(SELECT count(*) FROM x WHERE ok AND noindex)", "site.broken_internal_links": "(SELECT count(*) FROM c WHERE NOT ok)",
}
ORACLE_SQL = {
    "canonical_conflicts": f"WITH {_C} SELECT {_U('src')} AS url, {_U('dst')} AS target, conflict FROM t WHERE conflict IS NOT NULL",
    "hreflang_broken": f"WITH {_C} SELECT {_U('src')} AS src, {_U('dst')} AS dst, CASE WHEN NOT ok THEN 'error' ELSE 'nonindexable' END AS problem FROM x WHERE NOT ok OR noindex",
    "hreflang_return": f"WITH {_C} SELECT {_U('src')} AS src, {_U('dst')} AS dst FROM x WHERE ok AND NOT back",
    "redirect_chains": f"WITH {_C} SELECT {_U('n')} AS url, CASE WHEN loops THEN 'loop' ELSE 'chain' END AS problem FROM c WHERE moved OR loops",
    "crawl_summary": f"WITH {_C} SELECT count(*) AS pages, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok AND NOT noindex) AS indexable, max(depth) AS max_depth FROM c",
    "dup_groups": f"WITH {_C}, d AS (SELECT title AS value, count(*) AS pages, list({_U('n')} ORDER BY {_U('n')}) AS urls FROM c WHERE ok AND NOT noindex AND title <> '' GROUP BY title HAVING count(*) > 1) SELECT value, pages, array_to_string(urls[1:{S.SAMPLE}], ',') AS sample FROM d",
    "follow_signals": f"WITH {_C} SELECT {_U('dst')} AS dst, 'nofollow_only' AS signal FROM g JOIN c ON n = dst WHERE lone AND ok AND NOT noindex UNION ALL SELECT {_U('dst')}, 'mixed' FROM g WHERE part AND NOT lone",
    "broken_links": f"WITH {_C}, i AS (SELECT dst, list(DISTINCT {_U('src')} ORDER BY {_U('src')}) AS srcs FROM l WHERE inbound GROUP BY dst) SELECT {_U('n')} AS url, 404 AS status, coalesce(array_to_string(srcs[1:{S.LINKERS}], ','), '') AS linked_from FROM c LEFT JOIN i ON dst = n WHERE NOT ok",
    "crosspage_findings": f"WITH {_C}, z AS (" + " UNION ALL ".join(f"SELECT '{k}' AS code, '{S.CROSSPAGE[k]}' AS severity, CAST({n} AS BIGINT) AS n" for k, n in _COUNTS.items()) + ") SELECT * FROM z WHERE n > 0",
    "link_edges": f"WITH {_C} SELECT {_U('src')} AS src, {_U('dst')} AS dst, bool_or(nofollow) AS nofollow, any_value(inbound) AS inbound FROM l GROUP BY src, dst",
}
