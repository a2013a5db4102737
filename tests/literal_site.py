"""Small recorded crawls, probes and files, and what the operators make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import audits as A
from pagelake.operators import site as S
from pagelake.plans.fixtures import Fixture, expected

_H = "https://s.test"
_PAGE = "url string, status int, depth int, ok boolean, media_type string, title string, description string, canonical string, robots string, body_hash string, redirect_chain array<string>, hreflangs array<struct<lang:string,url:string>>"


def _p(path: str, status: int = 200, depth: int = 1, title: str | None = None, desc: str | None = None, canonical: str | None = None, robots: str | None = None, body: str | None = None, chain: list[str] | None = None, alt: list[tuple[str, str]] = ()) -> tuple:
    url = _H + path
    return (url, status, depth, status < 400, "text/html", title or path, desc, canonical, robots, body or path, chain or [url], [{"lang": lang, "url": _H + u} for lang, u in alt])


CRAWL = Fixture("crawl", _PAGE, [
    _p("/", depth=0, title="Home"), _p("/a", title="Home", body="same", alt=[("fr", "/b"), ("de", "/gone")]), _p("/b", body="same", desc="d"), _p("/c", desc="d", canonical=_H + "/gone"),
    _p("/gone", status=404, title="Home", body="same"), _p("/n", robots="noindex", title="Home"), _p("/d", depth=5, canonical=_H + "/n"), _p("/e", canonical=_H + "/c", alt=[("en", "/f")]),
    _p("/f", chain=[_H + "/x", _H + "/y", _H + "/f"], alt=[("en", "/e"), ("fr", "/n")]), _p("/g", chain=[_H + "/g", _H + "/z", _H + "/g"], canonical=_H + "/f"), _p("/lone"),
])
_E = [("/", "/a", False), ("/", "/b", True), ("/", "/c", True), ("/a", "/c", False), ("/", "/gone", False), ("/a", "/gone", False), ("/b", "/n", True), ("/c", "/d", False), ("/d", "/e", True), ("/e", "/f", False), ("/f", "/g", False)]
EDGES = Fixture("edges", "src string, dst string, nofollow boolean", [(_H + a, _H + b, n) for a, b, n in _E])
_FINE = "(media_type = 'text/html' AND ok AND coalesce(robots, '') NOT LIKE '%noindex%')"
_W = f"WITH {CRAWL.cte()}, {EDGES.cte()}"


ROBOTS = Fixture("robots", "site string, body string", [
    ("s", "# all\nUser-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nAllow: /*.html$\n"), ("t", "User-agent: *\nDisallow:\nSitemap: https://t/s.xml"), ("u", "User-agent: *\nDisallow: /a\nAllow: /a"),
])
ASKED = Fixture("asked", "site string, agent string, path string", [
    ("s", "Other", "/private/x"), ("s", "Other", "/private/open"), ("s", "GPTBot", "/x"), ("s", "GPTBot", "/x.html"), ("s", "CCBot", "/x.htmlx"), ("s", "Other", "/"), ("t", "GPTBot", "/a"), ("u", "X", "/a"), ("none", "X", "/a"),
])
SITEMAPS = Fixture("maps", "site string, url string, body string", [
    ("s", "https://s.test/m.xml", f"<urlset><url><loc>{_H}/a</loc></url><url><loc> {_H}/gone </loc></url><url><loc>{_H}/a?x=1&amp;y=2</loc></url><url><loc></loc></url></urlset>"),
    ("t", "https://t/m.xml", "<sitemapindex><sitemap><loc>https://t/1.xml</loc></sitemap></sitemapindex>"), ("u", "https://u/m.txt", "https://u/1\nhttps://u/2\n"), ("v", "https://v/m", "nothing"),
])


def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.robots_verdict(S.robots_rules(ROBOTS.df(spark)), ASKED.df(spark))


def sitemap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sitemap_diff(S.sitemap_entries(SITEMAPS.df(spark).where("site = 's'")), CRAWL.df(spark))


PROBES = Fixture("probes", "url string, agent string, status int, words int, challenged boolean", [
    ("a", "browser", 200, 100, False), ("a", "GPTBot", 403, 0, False), ("a", "CCBot", 200, 40, False), ("a", "YouBot", 200, 60, False), ("b", "browser", 503, 0, False), ("b", "GPTBot", 200, 10, False), ("a", "ClaudeBot", 200, 90, True), ("a", "Diffbot", None, None, False),
])
LINK_PROBES = Fixture("probes", "url string, status int, final_url string, error string", [("a", 200, "a", None), ("b", 404, None, None), ("c", 200, "d", None), ("e", 301, None, None), ("f", 0, None, "timeout"), ("g", 0, None, None)])
IMAGES = Fixture("probes", "url string, status int, bytes long", [("a", 200, 500000), ("b", 200, 500001), ("c", 404, 10), ("d", 200, 900000)])
LLMS = Fixture("files", "site string, body string", [("a", "# Name\n> about"), ("b", "no heading"), ("c", None), ("d", "  ")])
NODES = Fixture("nodes", "page_id long, type string, props array<string>", [(1, "Product", ["name", "image"]), (2, "Article", ["author"]), (3, "Person", ["name", "url", "sameAs", "jobTitle"]), (4, "Unknown", ["x"])])
REMEDY = Fixture("found", "code string, severity string", [("site.orphan_pages", "high"), ("graph.unlinked", "low"), ("schema.missing", "low"), ("robots.disallowed", "critical"), ("title.short", "info"), ("unknown.code", "high")])
CAPTURED = Fixture("captured", "page_id long, status int, ok boolean, media_type string, html string, headers map<string,string>", [
    (1, 403, False, "text/html", "<html></html>", {"cf-mitigated": "challenge"}), (2, 200, True, "text/html", "<title>Just a moment...</title>", {}), (3, 404, False, "text/html", "gone", {}), (4, 200, True, "application/pdf", "", {}), (5, 0, False, None, None, {}), (6, 200, True, "text/html", "<p>fine</p>", {}), (7, 403, False, "text/html", "<div class=h-captcha>hcaptcha</div>", {}),
])
HEADERS = Fixture("headers", "id long, header string", [(1, "text/html; charset=UTF-8"), (2, "Application/PDF"), (3, None), (4, "text/html;charset='latin-1'; x=y")])


def _over(fixture: Fixture, f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(fixture.df(spark))

    return run


QUERIES = {f.__name__: f for f in (robots_verdict, sitemap_diff)}
QUERIES |= {
    "crawler_probe": _over(PROBES, A.crawler_probe), "link_status": _over(LINK_PROBES, A.link_status), "image_weights": _over(IMAGES, A.image_weights), "llms_check": _over(LLMS, A.llms_findings),
    "schema_rules": _over(NODES, A.schema_rules), "remedy_phases": _over(REMEDY, A.remedy_phases),
    "auditable": _over(CAPTURED, A.auditable), "challenge": _over(CAPTURED, A.challenge), "content_type": _over(HEADERS, lambda d: d.select("id", A.content_type(F.col("header")).alias("c")).select("id", "c.*")),
    "badge": _over(HEADERS, lambda d: d.where("id = 2").select(A.badge(F.lit("score"), F.lit("87")).alias("svg"))),
}
ORACLE_SQL = {
    "crawler_probe": f"WITH {PROBES.cte()} SELECT p.url, p.agent, CASE WHEN b.status >= 500 OR b.status IN (401, 403, 429) OR b.challenged OR b.status IS NULL THEN 'baseline_unavailable' WHEN p.status IS NULL THEN 'untested' WHEN p.status >= 500 OR p.status IN (401, 403, 429) OR p.challenged THEN 'blocked' WHEN b.words >= 50 AND p.words < b.words / 2 THEN 'degraded' ELSE 'allowed' END AS verdict FROM probes p LEFT JOIN probes b ON p.url = b.url AND b.agent = 'browser' WHERE p.agent <> 'browser'",
    "link_status": f"WITH {LINK_PROBES.cte()} SELECT url, CASE WHEN error IS NOT NULL THEN 'blocked' WHEN status >= 400 OR status = 0 THEN 'broken' WHEN status BETWEEN 300 AND 399 OR final_url <> url THEN 'redirecting' ELSE 'ok' END AS class FROM probes",
    "image_weights": f"WITH {IMAGES.cte()} SELECT CASE WHEN status >= 400 OR status = 0 THEN 'image.broken' ELSE 'image.too_large' END AS code, count(*) AS n FROM probes WHERE bytes > 500000 OR status >= 400 OR status = 0 GROUP BY 1",
    "llms_check": expected("site string, code string", [("a", "llms.present"), ("b", "llms.malformed"), ("c", "llms.missing"), ("d", "llms.missing")]),
    "schema_rules": expected("page_id long, type string, missing string, lacking string", [(1, "Product", "", "description,offers,aggregateRating,brand"), (2, "Article", "headline", "datePublished,image,dateModified"), (3, "Person", "", "")]),
    "remedy_phases": expected("phase int, remedy string, codes string, severity string, cost double", [(1, "crawler access", "robots.disallowed", "critical", 0.015), (2, "structure", "graph.unlinked,site.orphan_pages", "high", 0.22), (3, "structured data", "schema.missing", "low", 0.055), (4, "metadata", "title.short", "info", 0.11)]),
    "auditable": expected("page_id long, reason string", [(1, "challenged"), (2, "challenged"), (3, "error status"), (4, "not html"), (5, "not fetched"), (6, None), (7, "challenged")]),
    "challenge": expected("page_id long, vendor string, evidence string, captcha boolean", [(1, "Cloudflare", "cf-mitigated", False), (2, "Cloudflare", "<title>Just a moment", False), *((i, None, None, None) for i in (3, 4, 5, 6)), (7, "an anti-bot service", "captcha", True)]),
    "content_type": expected("id long, media string, charset string", [(1, "text/html", "utf-8"), (2, "application/pdf", None), (3, "", None), (4, "text/html", "latin-1")]),
    "badge": expected("svg string", [('<svg xmlns="http://www.w3.org/2000/svg" width="82" height="20"><text x="10" y="14">score</text><text x="60" y="14">87</text></svg>',)]),
    "robots_verdict": expected("site string, agent string, path string, allowed boolean", [
        ("s", "Other", "/private/x", False), ("s", "Other", "/private/open", True), ("s", "GPTBot", "/x", False), ("s", "GPTBot", "/x.html", True), ("s", "CCBot", "/x.htmlx", False), ("s", "Other", "/", True), ("t", "GPTBot", "/a", True), ("u", "X", "/a", True), ("none", "X", "/a", True),
    ]),
    "sitemap_diff": f"{_W}, m AS (SELECT * FROM (VALUES ('{_H}/a'), ('{_H}/gone'), ('{_H}/a?x=1&y=2')) AS t(loc)) SELECT * FROM (SELECT coalesce(loc, url) AS url, CASE WHEN url IS NULL THEN 'not_crawled' WHEN loc IS NULL THEN CASE WHEN {_FINE} THEN 'not_listed' END WHEN status >= 400 THEN 'broken' WHEN NOT {_FINE} THEN 'noindex' ELSE 'ok' END AS verdict FROM m FULL JOIN crawl ON loc = url) WHERE verdict IS NOT NULL",
}
