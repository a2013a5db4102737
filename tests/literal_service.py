"""Small recorded pages, figures and runs, and what the services make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.operators import geo_score as G
from pagelake.operators import services as V
from pagelake.operators import site as S
from pagelake.plans.fixtures import Fixture, expected

from .literal_site import ASKED, CRAWL, ROBOTS, SITEMAPS

_HTML = (
    '<html lang="en"><head><link rel="alternate" hreflang="en" href="https://a/en"><link rel=alternate hreflang=EN href="https://a/x"><link rel="alternate" hreflang="fr" href="https://a/fr"></head>'
    '<body><img src="a.png" alt="x" width="1" height="2"><img data-src="b.png"><img srcset="c.png 1x, d.png 2x" alt=""></body></html>'
)
PAGES = Fixture("pages", "page_id long, url string, html string, headers map<string,string>", [(1, "https://a/en", _HTML, {"link": '<https://a/de>; rel="alternate"; hreflang="de", <https://a/z>; rel="next"'}), (2, "https://a/n", None, {})])
SIGNALS = Fixture("s", "page_id long, key string, earned int", [(1, "ai_discovery_well_known", 2), (1, "ai_discovery_summary", 2), (1, "ai_discovery_faq", 1), (1, "llms_depth", 2), (1, "schema_richness", 3), (2, "ai_discovery_summary", 1), (3, "meta_title", 5), (4, "ai_discovery_well_known", 2), (4, "ai_discovery_summary", 2), (4, "ai_discovery_faq", 1)])
RUNS = Fixture("r", "service string, ok boolean, settled boolean, price double", [("a", True, True, 0.01), ("b", False, True, 0.005), ("c", True, False, 0.1)])
ENVELOPES = Fixture("e", "tool string, url string, score int", [("geo.score", "https://a/", 42)])
FIGURES = Fixture("f", "page_id long, ord int, label string, value string", [(1, 2, "B & C", "<5%"), (1, 1, "A", "43%")])
QUESTIONS = Fixture("q", "ord int, question string, brand string", [(1, "Is Acme good?", "acme"), (2, "Best crm for teams?", "acme")])
CITED_A = Fixture("a", "source string, title string, url string, error string", [("wiki", "x", "https://w/1", None), ("wiki", "y", "https://w/2", None)])
CITED_B = Fixture("b", "source string, url string, error string", [("forum", None, "timeout")])


def _facts(spark: SparkSession) -> DataFrame:
    from pagelake.functions.facts import with_facts

    return with_facts(PAGES.df(spark))


def _over(fixture: Fixture, f):
    return lambda spark, sf_dir: f(fixture.df(spark))


def robots_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.robots_findings(S.robots_verdict(S.robots_rules(ROBOTS.df(spark)), ASKED.df(spark)))


def robots_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    bots = spark.createDataFrame([(s, b, "/x") for s in ("s", "t") for b in ("OAI-SearchBot", "ClaudeBot", "Claude-SearchBot", "PerplexityBot")], "site string, agent string, path string")
    return V.robots_points(S.robots_verdict(S.robots_rules(ROBOTS.df(spark)), bots))


def sitemap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sitemap_findings(S.sitemap_diff(S.sitemap_entries(SITEMAPS.df(spark).where("site = 's'")), CRAWL.df(spark)))


def links_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.citations(CITED_A.df(spark), CITED_B.df(spark))


QUERIES = {f.__name__: f for f in (robots_findings, robots_points, sitemap_findings, links_inbound)}
QUERIES |= {
    "images_extract": lambda spark, sf_dir: V.images(_facts(spark)), "hreflang_extract": lambda spark, sf_dir: V.hreflangs(_facts(spark)), "hreflang_dups": lambda spark, sf_dir: V.duplicate_langs(V.hreflangs(_facts(spark))),
    "readiness_level": _over(SIGNALS, G.readiness_level), "evidence_runs": _over(RUNS, V.evidence), "envelope_json": _over(ENVELOPES, V.envelope),
    "figures_table": _over(FIGURES, V.figures_table), "ai_prompts": _over(QUESTIONS, V.questions_without_brand),
}
ORACLE_SQL = {
    "robots_findings": expected("site string, code string", [("s", "robots.ai_disallowed"), ("t", "robots.allowed"), ("u", "robots.allowed"), ("none", "robots.allowed")]),
    "robots_points": expected("site string, points int", [("s", 13), ("t", 13)]),
    "sitemap_findings": expected("code string, n long", [("sitemap.lists_broken_urls", 1), ("sitemap.orphans", 1), ("sitemap.incomplete", 8)]),
    "links_inbound": expected("source string, found long, unreachable boolean", [("wiki", 2, False), ("forum", 0, True)]),
    "images_extract": expected("page_id long, pos int, src string, alt string, has_size boolean", [(1, 0, "a.png", "x", True), (1, 1, "b.png", None, False), (1, 2, "c.png", "", False)]),
    "hreflang_extract": expected("page_id long, lang string, href string, source string", [(1, "en", "https://a/en", "html"), (1, "EN", "https://a/x", "html"), (1, "fr", "https://a/fr", "html"), (1, "de", "https://a/de", "header")]),
    "hreflang_dups": expected("page_id long, lang string, n long", [(1, "en", 2)]),
    "readiness_level": expected("page_id long, level string", [(1, "advanced"), (2, "basic"), (3, "none"), (4, "ready")]),
    "evidence_runs": expected("runs long, passed long, settled long, price double", [(3, 2, 2, 0.115)]),
    "envelope_json": "SELECT 'https://a/' AS url, '{\"tool\":{\"name\":\"geo.score\",\"version\":\"1\"},\"output_hash\":\"sha256:' || sha256('{\"score\":42,\"url\":\"https://a/\"}') || '\",\"result\":{\"score\":42,\"url\":\"https://a/\"}}' AS envelope",
    "figures_table": expected("page_id long, html string", [(1, "<table><tr><td>A</td><td>43%</td></tr><tr><td>B &amp; C</td><td>&lt;5%</td></tr></table>")]),
    "ai_prompts": expected("ord int, question string", [(2, "Best crm for teams?")]),
}
