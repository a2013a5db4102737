"""Keywords, demand, captures, probes, files and recorded runs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import urls as U
from pagelake.functions.constants import INTENTS, KEYWORD_STOP, PREPOSITIONS, PRICES, QUESTION_WORDS, REMEDIES, SCHEMA_RULES
from pagelake.operators import audits as A
from pagelake.operators import geo_score as G
from pagelake.operators import market as M
from pagelake.operators import page_checks as C
from pagelake.operators import services as V
from pagelake.operators import site as S

from .crawl_queries import _C, _U, SITE, _crawl
from .fixtures import literal
from .page_queries import _F, _pages, _prepared, damaged, defect_findings, geo_score, site_files
from .page_queries import ORACLE_SQL as _PAGE_SQL
from .page_queries import _DEFECTS as _DEFECT_SQL
from .page_queries import _EARNED, _POINTS, _X
from .page_queries import readiness_pages
from .report_queries import _INTENT, _PHRASES, _probed
from .text_queries import _t


def _pick(n: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase for each part: words of an intent, then the part's name."""
    n = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(n.cast("int").alias("ord"), F.concat(_pick(n, _PHRASES), F.lit(" "), F.lower("p_name")).alias("phrase"))


def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("ord", M.intent(F.col("phrase")).alias("intent"))


def intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent(spark, sf_dir).groupBy("intent").agg(F.count("*").alias("n"))


def kw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("ord", F.array_join(M.tokens(F.col("phrase")), " ").alias("tokens"))


def kw_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the distinct phrases of all parts."""
    return M.cluster(_phrases(spark, sf_dir).groupBy("phrase").agg(F.min("ord").alias("ord")))


def kw_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of a suggestion engine for each nation's name."""
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(M.variations_of(F.lower("n_name"))).alias("ord", "variation"))


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id")
    phrase = F.concat(F.when(n % 2 == 0, " CRM   ").otherwise("crm "), _pick(n, ("tools", "app", "price", "for teams")), F.when(n % 7 == 0, " now").otherwise(""))
    return _t(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.lit("crm").alias("variation"), F.when(n % 9 == 5, "other thing").otherwise(phrase).alias("phrase"), F.when(F.col("event_id") % 13 == 0, "timeout").alias("error"))


def kw_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of all engines as one list, the most seen first; how many are left out of it."""
    return M.suggestions_ranked(_suggested(spark, sf_dir), "crm").withColumn("sources", F.array_join("sources", ","))


def kw_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.engine_failures(_suggested(spark, sf_dir))


def demand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as components of a customer's demand, some of them not measured."""
    n = F.col("o_orderkey")
    return M.demand_index(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seed"), F.col("o_orderpriority").alias("component"), F.when(n % 4 > 0, (n % 5) / 4).alias("score"), (n % 3 * 10 + 15).cast("int").alias("weight")))


def interest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month as the interest in each customer's nation; nations with few months have no trend."""
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.where((F.col("c_nationkey") % 5 > 0) | (F.month("o_orderdate") + 12 * F.year("o_orderdate") < 12 * 1995 + 4))
    return M.interest(o.groupBy(F.col("c_nationkey").alias("topic"), F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(F.count("*").alias("views")))


def corpus_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures of customers' domains in yearly crawls, some of which could not be reached."""
    d, y = F.col("o_custkey") % 60, F.year("o_orderdate")
    lost = (d == 7) | ((d % 10 == 8) & (y == 1995))
    url = F.when(~lost & (d % 10 != 9), F.concat(F.lit("https://d/"), (F.col("o_orderkey") % 500).cast("string")))
    return M.corpus_presence(_t(spark, sf_dir, "orders").select(d.alias("domain"), y.cast("string").alias("crawl"), url.alias("url"), F.when(F.col("o_orderstatus") == "F", "404").otherwise("200").alias("status"), F.when(F.col("o_orderstatus") == "P", "application/pdf").otherwise("text/html").alias("mime"), lost.alias("unreachable")))


def model_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation that a model answered at some length."""
    return M.model_chain(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("prompt"), F.col("turn").alias("position"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("model"), F.when((F.col("role") == "assistant") & (F.length("text") > 200), F.col("text")).alias("answer")))


def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON in the wrappers that models put around it."""
    body = F.concat(F.lit('{"a": '), F.col("turn").cast("string"), F.lit("}"))
    n = F.col("conv_id") % 6
    raw = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(n == 3, F.concat(F.lit("Here ["), body, F.lit(", 2] ok"))).when(n == 4, F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", M.json_tolerant(raw).alias("json"))


def stable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of runs, in another order of keys and with times of their own."""
    k = F.col("o_custkey").cast("string")
    a = F.concat(F.lit('{"b": 1, "a": {"ttfb_ms": '), F.col("o_orderkey").cast("string"), F.lit(', "x": ['), k, F.lit(", 2]}}"))
    b = F.concat(F.lit('{"a": {"x": ['), k, F.lit(', 2], "elapsed_ms": 9}, "b": 1, "fetched_at": "'), F.col("o_orderdate").cast("string"), F.lit('"}'))
    return M.stable_digest(_t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(b).alias("json")), "json").select("o_orderkey", "digest")


def contains_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents hold quotes of their first words: as they are, in brackets, with a foreign end, or reversed."""
    w, n = F.slice(T.words(F.col("text")), 1, 14), F.col("doc_id") % 5
    plain = F.array_join(w, " -- ")
    quote = F.when(n == 0, plain).when(n == 1, F.concat(F.lit(" ("), plain, F.lit(")!"))).when(n == 2, F.concat(plain, F.lit(" zz yy"))).when(n == 3, F.concat(F.lit("zz "), plain)).otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", T.contains_norm(F.col("text"), quote).alias("found"))


_TAGS = ("", "-US", "lish", "-Hans", "_US", "-x")


def lang_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents' languages, changed in some way, are language tags."""
    return _t(spark, sf_dir, "documents").select("doc_id", M.language_tag(F.concat("lang", _pick(F.col("doc_id"), _TAGS))).alias("valid"))


def schema_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' titles against headlines: a part of the title, words of it in another order, or another page's matter."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    w = F.filter(F.split(title, " "), lambda x: x.rlike("^[A-Za-z]+$"))
    p = _pages(spark, sf_dir).select("page_id", title.alias("title"), w.alias("w"))
    n = F.col("page_id") % 3
    headline = F.when(n == 0, F.substring("title", 1, 9)).when(n == 1, F.array_join(F.reverse(F.slice("w", 1, 6)), " ")).otherwise("Rocket science basics")
    return M.title_agreement(p.where("size(w) >= 3").select(F.col("page_id").alias("id"), "title", headline.alias("headline")))


def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the damaged pages that leave out a level."""
    f = C.prepared(C.captured(damaged(_pages(spark, sf_dir))), ("headings",))
    return M.heading_skips(f.select("page_id", F.posexplode("headings").alias("pos", "h")).select("page_id", "pos", "h.level"))


_HOSTS = ("http://127.0.0.1/x", "http://a.example:8080/", "http://10.1.2.3/", "http://localhost/", "http://192.168.1.4:80/", "ftp://a.example", "https://a.example:443/x", "http://172.20.0.1/", "http://172.32.0.1/", "http://169.254.1.1/", "http://0.0.0.0/", "javascript:x")
_MAY = (False, False, False, False, False, False, True, False, True, False, False, False)


def guard_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pages' addresses, some of them replaced by such as must not be fetched, may be."""
    n = F.col("page_id")
    return M.guard_static(_pages(spark, sf_dir).select(n.alias("id"), F.when(n % 2 == 0, F.col("url")).otherwise(_pick(F.floor(n / 2), _HOSTS)).alias("url")))


def _robots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, asked): a robots file for each page's address of its own, and what three agents ask of it."""
    path = F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url")))
    p = _pages(spark, sf_dir).select(F.col("page_id").alias("n"), F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("site"), path.alias("path"))
    own = F.when(F.col("n") % 2 == 0, F.concat(F.lit("Allow: "), "path", F.lit("$\n"))).otherwise("")
    digit = F.concat(F.lit("Allow: /*"), (F.col("n") % 10).cast("string"), F.lit("$\n"))
    body = F.concat(F.lit("# all\nUser-agent: *\nDisallow: "), F.substring("path", 1, 3), F.lit("\n"), own, F.lit("\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n"), digit, F.lit("Sitemap: x\n"))
    asked = p.select("site", "path", F.explode(F.array(*map(F.lit, ("Other", "gptbot", "CCBot/2.0")))).alias("agent"))
    return p.where("n % 9 <> 3").select("site", body.alias("body")), asked


def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, asked = _robots(spark, sf_dir)
    return S.robots_verdict(S.robots_rules(files), asked)


def robots_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, asked = _robots(spark, sf_dir)
    asked = asked.withColumn("agent", F.when(F.col("agent") == "Other", "*").otherwise(F.col("agent")))
    return V.robots_findings(S.robots_verdict(S.robots_rules(files), asked))


def robots_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each site of the pages for its robots file, at the path of /en/."""
    from pagelake.functions.constants import CITATION_BOTS

    files = site_files(spark, sf_dir).where("kind = 'robots'").select("site", "body")
    asked = files.select("site", F.lit("/en/x").alias("path"), F.explode(F.array(*map(F.lit, CITATION_BOTS))).alias("agent"))
    return V.robots_points(S.robots_verdict(S.robots_rules(files), asked))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sitemap of the crawled site lists: two thirds of its pages, and some that are not there."""
    n = F.col("page_id")
    locs = F.array_compact(F.array(F.when(n % 3 > 0, F.concat(F.lit(SITE), n.cast("string"))), F.when(n % 20 == 7, F.concat(F.lit(SITE), n.cast("string"), F.lit("/gone")))))
    return _pages(spark, sf_dir).select(F.explode(locs).alias("loc"))


def sitemap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sitemap_diff(_listed(spark, sf_dir), _crawl(spark, sf_dir))


def sitemap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sitemap_findings(sitemap_diff(spark, sf_dir))


def crawler_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a browser and three crawlers got it: refused, shortened, challenged, or not at all."""
    n, agent = F.col("page_id"), F.col("agent")
    p = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(F.array(*map(F.lit, ("browser", "GPTBot", "CCBot", "ClaudeBot")))).alias("k", "agent"))
    status = F.when((agent == "browser") & (n % 17 == 3), 503).when((agent != "browser") & ((n + F.col("k")) % 5 == 0), 403).when((agent != "browser") & ((n + F.col("k")) % 11 == 1), None).otherwise(200)
    words = F.when(agent == "browser", 100 + n % 50).otherwise(40 + (n * F.col("k")) % 90).cast("int")
    return A.crawler_probe(p.select("url", "agent", status.alias("status"), words.alias("words"), ((agent == "ClaudeBot") & (n % 13 == 2)).alias("challenged")))


def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each link of the pages."""
    return A.link_status(_probed(spark, sf_dir).drop("internal"))


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the damaged pages as if they had been fetched."""
    f = V.images(C.prepared(C.captured(damaged(_pages(spark, sf_dir))), ("images",)))
    n = F.col("page_id")
    return f.select("page_id", F.concat("src", F.lit("?"), n.cast("string")).alias("url"), F.when(n % 5 == 0, 404).otherwise(200).alias("status"), (n * 99_991 % 1_000_000).cast("long").alias("bytes"))


def image_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.image_weights(_weighed(spark, sf_dir))


def heavy_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest images of each page, and how many are left out."""
    return A.heaviest(_weighed(spark, sf_dir))


def llms_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """llms.txt of every site of the pages."""
    url = F.col("url")
    sites = _pages(spark, sf_dir).select(F.concat(U.scheme(url), F.lit("://"), U.netloc(url)).alias("site")).distinct()
    return A.llms_findings(sites.join(site_files(spark, sf_dir).where("kind = 'llms'").select("site", "body"), "site", "left"))


def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nodes of the damaged pages' structured data lack."""
    f = C.prepared(C.captured(damaged(_pages(spark, sf_dir))), ("nodes",))
    return A.schema_rules(f.select("page_id", F.explode("nodes").alias("n")).select("page_id", F.explode("n.types").alias("type"), F.col("n.props").alias("props")))


def remedy_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remedies for what the damaged pages' checks have found."""
    return A.remedy_phases(defect_findings(spark, sf_dir).select("code", "severity"))


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they were captured: behind anti-bot services, broken, not fetched, or no pages."""
    n = F.col("page_id") % 9
    empty = F.create_map().cast("map<string,string>")
    return _pages(spark, sf_dir).select(
        "page_id", F.when(n.isin(0, 6), 403).when(n == 2, 404).when(n == 4, 0).otherwise(200).alias("status"), (~n.isin(0, 2, 4, 6)).alias("ok"), F.when(n == 3, "application/pdf").when(n != 4, "text/html").alias("media_type"),
        F.when(n == 1, F.concat(F.lit("<title>\nJust a Moment...</title>"), "html")).when(n == 6, F.concat(F.lit("<div class=h-captcha>hCaptcha</div>"), "html")).otherwise(F.col("html")).alias("html"),
        F.when(n == 0, F.create_map(F.lit("cf-mitigated"), F.lit("Challenge"))).when(n == 5, F.create_map(F.lit("cf-mitigated"), F.lit("other"))).otherwise(empty).alias("headers"),
    )


def auditable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.auditable(_captured(spark, sf_dir))


def challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.challenge(_captured(spark, sf_dir))


def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-Type headers as servers write them."""
    n, lang = F.col("doc_id") % 5, F.coalesce("lang", F.lit("x"))
    header = F.when(n == 0, F.concat(F.lit("Text/HTML; Charset="), F.upper(lang))).when(n == 1, F.concat(lang, F.lit("/PDF"))).when(n == 2, F.concat(F.lit("text/html;charset='"), lang, F.lit("'; x=y"))).when(n == 3, "")
    return _t(spark, sf_dir, "documents").select("doc_id", A.content_type(header).alias("c")).select("doc_id", "c.media", "c.charset")


def badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A badge for each page's score."""
    return geo_score(spark, sf_dir).select("page_id", A.badge(F.col("band"), F.col("score").cast("string")).alias("svg"))


_TAGGED = '<link rel="alternate" hreflang="en" href="/en"><link rel=alternate hreflang=EN href="/x"><link rel="alternate" hreflang="fr" href="/fr">'
_PICTURED = '<img src="a.png" alt="x" width="1" height="2"><img data-src="b.png"><img srcset="c.png 1x, d.png 2x" alt="">'


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every third has alternates and images, every fourth a Link header."""
    n = F.col("page_id")
    html = F.when(n % 3 == 0, F.replace(F.replace("html", F.lit("<head>"), F.lit("<head>" + _TAGGED)), F.lit("<body>"), F.lit("<body>" + _PICTURED))).otherwise(F.col("html"))
    link = F.create_map(F.lit("link"), F.concat(F.lit('</de/'), n.cast("string"), F.lit('>; rel="alternate"; hreflang="de", </z>; rel="next"')))
    return C.prepared(C.captured(_pages(spark, sf_dir).withColumn("html", html)).withColumn("headers", F.when(n % 4 == 0, link).otherwise(F.col("headers"))), ("images", "hreflangs"))


def images_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.images(_tagged(spark, sf_dir))


def hreflang_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hreflangs(_tagged(spark, sf_dir))


def hreflang_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.duplicate_langs(V.hreflangs(_tagged(spark, sf_dir)))


def readiness_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages have reached each level."""
    return readiness_pages(spark, sf_dir).groupBy("level").agg(F.count("*").alias("pages"))


def weakest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories in which each site's pages miss the most of what they could earn, three at most."""
    f = _prepared(spark, sf_dir)
    s = G.geo_signals(f).join(f.select("page_id", U.registrable(U.host(F.col("url"))).alias("site")), "page_id")
    return G.weakest_categories(s)


def strongest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pages of the highest score, and how many are left out."""
    from pagelake.operators import reports as R

    return R.capped(geo_score(spark, sf_dir).select("page_id", "score"), G.STRONGEST, F.desc("score"), F.asc("page_id"))


def links_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cite: events that name an address, or fail."""
    n, e = F.col("event_id"), _t(spark, sf_dir, "events")
    a = e.where("event_type <> 'error'").select(F.col("event_type").alias("source"), F.lit("t").alias("title"), F.when(n % 3 > 0, F.concat(F.lit("https://w/"), n.cast("string"))).alias("url"), F.when((n % 701 == 0) & (F.col("event_type") < "p"), "timeout").alias("error"))
    return V.citations(a, e.where("event_type = 'error'").select(F.col("event_type").alias("source"), F.lit(None).cast("string").alias("url"), F.lit("refused").alias("error")))


def evidence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of the services."""
    n = F.col("o_orderkey")
    return V.evidence(_t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("service"), (F.col("o_orderstatus") == "F").alias("ok"), (n % 3 > 0).alias("settled"), (n % 8 / 8).alias("price")))


def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.envelope(geo_score(spark, sf_dir).join(_pages(spark, sf_dir).select("page_id", "url"), "page_id").select(F.lit("geo.score").alias("tool"), "url", "score"))


def figures_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a table of figures."""
    return V.figures_table(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("ord"), F.concat("o_orderstatus", F.lit(" & <"), "o_orderpriority").alias("label"), F.concat(F.lit('"'), (F.col("o_orderkey") % 97).cast("string"), F.lit("%")).alias("value")))


def ai_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as questions, without those that name the brand."""
    c = _t(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return V.questions_without_brand(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("question"), F.lit("THE").alias("brand"))).select("ord", F.sha2("question", 256).alias("question"))


QUERIES = {f.__name__: f for f in (
    intent, intent_counts, kw_tokens, kw_cluster, kw_variations, kw_merge, kw_failures, demand_index, interest_series, corpus_presence, model_chain, json_tolerant, stable_digest, contains_norm, lang_valid, schema_contradiction, heading_skips, guard_static,
    robots_verdict, robots_findings, robots_points, sitemap_diff, sitemap_findings, crawler_probe, link_status, image_weights, heavy_images, llms_check, schema_rules, remedy_phases, auditable, challenge, content_type, badge, images_extract, hreflang_extract,
    hreflang_dups, readiness_level, weakest_categories, strongest_scores, links_inbound, evidence_runs, envelope_json, figures_table, ai_prompts,
)}

_L = literal
_P = f"q AS (SELECT CAST(p_partkey AS INTEGER) AS ord, {_L(list(_PHRASES))}[p_partkey % {len(_PHRASES)} + 1] || ' ' || lower(p_name) AS p FROM part)"
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(phrase, {_L(rx)}) THEN {_L(k)}" for k, rx in INTENTS) + " ELSE 'informational' END"
_SEEN = "g AS (SELECT event_type AS engine, event_id % 13 = 0 AS failed, CASE WHEN user_id % 9 = 5 THEN 'other thing' ELSE 'crm ' || ['tools', 'app', 'price', 'for teams'][user_id % 4 + 1] || CASE WHEN user_id % 7 = 0 THEN ' now' ELSE '' END END AS phrase FROM events)"
_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_ROBOTS = f"""{_F}, z AS (SELECT page_id AS n, 's' || page_id AS site, CASE WHEN path = '' THEN '/' ELSE path END AS path, page_id % 9 <> 3 AS has FROM u),
y AS (SELECT *, unnest(['Other', 'gptbot', 'CCBot/2.0']) AS agent FROM z), v AS (SELECT n, site, agent, path, CASE WHEN NOT has THEN true WHEN agent = 'Other' THEN n % 2 = 0 ELSE suffix(path, CAST(n % 10 AS VARCHAR)) END AS allowed FROM y)"""
_PAGE = "CASE WHEN path = '' THEN '/' ELSE path END"
_PROBES = """p AS (SELECT page_id AS n, url, unnest(['browser', 'GPTBot', 'CCBot', 'ClaudeBot']) AS agent, unnest([0, 1, 2, 3]) AS k FROM pages),
q AS (SELECT url, agent, CASE WHEN agent = 'browser' AND n % 17 = 3 THEN 503 WHEN agent <> 'browser' AND (n + k) % 5 = 0 THEN 403 WHEN agent <> 'browser' AND (n + k) % 11 = 1 THEN NULL ELSE 200 END AS status, CASE WHEN agent = 'browser' THEN 100 + n % 50 ELSE 40 + (n * k) % 90 END AS words, agent = 'ClaudeBot' AND n % 13 = 2 AS challenged FROM p)"""
_IMAGES = "i AS (SELECT page_id, 'a.bmp?' || page_id AS url FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'b.png?' || page_id FROM pages WHERE page_id % 4 = 2), w AS (SELECT page_id, url, page_id % 5 = 0 AS broken, page_id * 99991 % 1000000 AS bytes FROM i)"
_LISTED = f"m AS (SELECT n AS i, {_U('n')} AS loc FROM c WHERE n % 3 > 0 UNION ALL SELECT NULL, {_U('n')} || '/gone' FROM c WHERE n % 20 = 7), j AS (SELECT coalesce(m.loc, {_U('c.n')}) AS url, CASE WHEN c.n IS NULL THEN 'not_crawled' WHEN m.loc IS NULL THEN CASE WHEN ok AND NOT noindex THEN 'not_listed' END WHEN NOT ok THEN 'broken' WHEN noindex THEN 'noindex' ELSE 'ok' END AS verdict FROM m FULL JOIN c ON m.i = c.n)"
_RULES = ", ".join(f"({i}, {_L(name)}, {_L(p)}, {round(sum(PRICES.get(s, 0) for s in services), 4)!r}::DOUBLE)" for i, (name, prefixes, services) in enumerate(REMEDIES) for p in prefixes)
_RANK = "list_position(['critical', 'high', 'low', 'info'], severity)"
_N9 = "page_id % 9"
_SITE = "array_to_string(string_split(regexp_replace(netloc, ':\\d*$', ''), '.')[-2:], '.')"
ORACLE_SQL = {
    "intent": f"WITH {_P} SELECT ord, {_INTENT} AS intent FROM q", "intent_counts": f"WITH {_P} SELECT {_INTENT} AS intent, count(*) AS n FROM q GROUP BY 1",
    "kw_tokens": f"WITH {_P} SELECT ord, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(p, '[a-z0-9'']+')), lambda x: length(x) > 1 AND NOT list_contains({_L(list(KEYWORD_STOP))}, x))), ' ') AS tokens FROM (SELECT ord, lower(p) AS p FROM q)",
    "kw_variations": f"WITH v AS (SELECT n_nationkey, lower(n_name) AS s FROM nation), a AS (SELECT n_nationkey, [s] || list_transform(range(97, 123), lambda c: s || ' ' || chr(CAST(c AS INTEGER))) || list_transform({_L(list(QUESTION_WORDS))}, lambda w: w || ' ' || s) || list_transform({_L(list(PREPOSITIONS))}, lambda w: s || ' ' || w) AS l FROM v) SELECT n_nationkey, CAST(unnest(range(len(l))) AS INTEGER) AS ord, unnest(l) AS variation FROM a",
    "kw_merge": f"WITH {_SEEN}, k AS (SELECT phrase, string_agg(DISTINCT engine, ',' ORDER BY engine) AS sources, count(*) AS seen FROM g WHERE NOT failed AND contains(phrase, 'crm') GROUP BY phrase) SELECT phrase, sources, seen, {_KINDS} AS intent, CAST(greatest((SELECT count(*) FROM k) - 500, 0) AS BIGINT) AS skipped FROM k",
    "kw_failures": f"WITH {_SEEN} SELECT engine, count(*) AS failures FROM g WHERE failed GROUP BY engine",
    "demand_index": "WITH c AS (SELECT o_custkey AS seed, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 / 4 END AS score, o_orderkey % 3 * 10 + 15 AS weight FROM orders) SELECT seed, round(100 * (sum(score * weight) / sum(weight) FILTER (score IS NOT NULL)), 1) AS demand_index, round(coalesce(sum(weight) FILTER (score IS NOT NULL), 0) / 100, 2) AS confidence FROM c GROUP BY seed",
    "interest_series": "WITH o AS (SELECT c_nationkey AS topic, strftime(o_orderdate, '%Y%m') AS month, count(*) AS views FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 > 0 OR month(o_orderdate) + 12 * year(o_orderdate) < 12 * 1995 + 4 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY month) AS i, count(*) OVER (PARTITION BY topic) AS n FROM o), "
    "a AS (SELECT topic, n, avg(views) FILTER (i <= n // 2) AS a, avg(views) FILTER (i > n // 2) AS b, CAST(floor(avg(views)) AS BIGINT) AS average FROM r GROUP BY topic, n) SELECT topic, n AS months, average, CASE WHEN n < 4 THEN NULL WHEN coalesce((b - a) / a, 0) > 0.15 THEN 'rising' WHEN coalesce((b - a) / a, 0) < -0.15 THEN 'falling' ELSE 'steady' END AS trend FROM a",
    "corpus_presence": "WITH k AS (SELECT o_custkey % 60 AS domain, year(o_orderdate) AS crawl, o_custkey % 60 = 7 OR (o_custkey % 10 = 8 AND year(o_orderdate) = 1995) AS lost, o_orderstatus AS s, CASE WHEN o_custkey % 10 <> 9 THEN 'https://d/' || o_orderkey % 500 END AS url FROM orders), "
    "a AS (SELECT domain, count(DISTINCT crawl) AS checked, count(DISTINCT crawl) FILTER (lost) AS unreachable, count(DISTINCT crawl) FILTER (NOT lost AND url IS NOT NULL) AS present, count(*) FILTER (NOT lost AND url IS NOT NULL) AS captures, count(*) FILTER (NOT lost AND s <> 'F') AS status_2xx, count(*) FILTER (NOT lost AND s <> 'P') AS html, count(DISTINCT url) FILTER (NOT lost) AS urls FROM k GROUP BY domain) "
    "SELECT *, CASE WHEN checked = unreachable THEN 'not measured' WHEN present = 0 AND unreachable = 0 THEN 'absent' WHEN unreachable > 0 THEN 'partly known' ELSE 'present' END AS verdict FROM a",
    "model_chain": "SELECT conv_id AS prompt, 'm' || min(turn) AS model, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' AND length(text) > 200 GROUP BY conv_id",
    "json_tolerant": """SELECT conv_id, turn, CASE WHEN conv_id % 6 IN (0, 1, 2) THEN '{"a":' || turn || '}' WHEN conv_id % 6 = 3 THEN '{"a":' || turn || '}' END AS json FROM conversations""",
    "stable_digest": "SELECT o_orderkey, 'sha256:' || sha256('{\"a\":{\"x\":[' || o_custkey || ',2]},\"b\":1}') AS digest FROM orders",
    "contains_norm": f"WITH w AS (SELECT doc_id, text, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')[1:14], ' -- ') AS p FROM documents), q AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN p WHEN 1 THEN ' (' || p || ')!' WHEN 2 THEN p || ' zz yy' WHEN 3 THEN 'zz ' || p ELSE '' END AS quote FROM w), "
    f"n AS (SELECT doc_id, {_N.format('coalesce(text, chr(32))')} AS h, {_N.format('quote')} AS n FROM q) SELECT doc_id, n <> '' AND (contains(h, n) OR len(string_split(n, ' ')) > 12 AND contains(h, array_to_string(string_split(n, ' ')[1:12], ' '))) AS found FROM n",
    "lang_valid": f"SELECT doc_id, doc_id % {len(_TAGS)} NOT IN (2, 4, 5) AS valid FROM documents",
    "schema_contradiction": "WITH t AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), w AS (SELECT *, list_filter(string_split(title, ' '), lambda x: regexp_full_match(x, '[A-Za-z]+')) AS w FROM t), h AS (SELECT id, title, CASE id % 3 WHEN 0 THEN title[1:9] WHEN 1 THEN array_to_string(list_reverse(w[1:6]), ' ') ELSE 'Rocket science basics' END AS headline FROM w WHERE len(w) >= 3), "
    "k AS (SELECT *, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(headline), '[a-z0-9]+')) AS b FROM h) SELECT id, NOT (contains(lower(title), lower(headline)) OR contains(lower(headline), lower(title))) AND len(list_intersect(a, b)) < greatest(1, least(len(a), len(b)) // 3) AS contradicts FROM k",
    "heading_skips": "SELECT page_id, 1 AS from_level, 4 AS to_level FROM pages WHERE page_id % 7 = 2",
    "guard_static": f"SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN true ELSE {_L(list(_MAY))}[page_id // 2 % {len(_MAY)} + 1] END AS allowed FROM pages",
    "robots_verdict": f"WITH {_ROBOTS} SELECT site, agent, path, allowed FROM v",
    "robots_findings": f"WITH {_ROBOTS}, k AS (SELECT site, bool_or(agent <> 'Other' AND NOT allowed) AS some_, bool_or(agent = 'Other' AND NOT allowed) AS all_ FROM v GROUP BY site) SELECT site, 'robots.ai_disallowed' AS code FROM k WHERE some_ UNION ALL SELECT site, 'robots.disallowed' FROM k WHERE all_ UNION ALL SELECT site, 'robots.allowed' FROM k WHERE NOT some_ AND NOT all_",
    "robots_points": f"WITH {_F}, s AS (SELECT DISTINCT scheme || '://' || netloc AS site FROM u) SELECT site, CASE length(site) % 5 WHEN 1 THEN 13 WHEN 2 THEN 10 ELSE 0 END AS points FROM s WHERE length(site) % 5 > 0",
    "sitemap_diff": f"WITH {_C}, {_LISTED} SELECT url, verdict FROM j WHERE verdict IS NOT NULL",
    "sitemap_findings": f"WITH {_C}, {_LISTED}, k AS (SELECT CASE verdict WHEN 'broken' THEN 'sitemap.lists_broken_urls' WHEN 'noindex' THEN 'sitemap.lists_noindex' WHEN 'not_listed' THEN 'sitemap.incomplete' WHEN 'not_crawled' THEN 'sitemap.orphans' END AS code FROM j) SELECT code, count(*) AS n FROM k WHERE code IS NOT NULL GROUP BY code",
    "crawler_probe": f"WITH {_PROBES} SELECT p.url, p.agent, CASE WHEN b.status >= 500 OR b.status IN (401, 403, 429) OR b.challenged OR b.status IS NULL THEN 'baseline_unavailable' WHEN p.status IS NULL THEN 'untested' WHEN p.status >= 500 OR p.status IN (401, 403, 429) OR p.challenged THEN 'blocked' WHEN b.words >= 50 AND p.words < b.words / 2 THEN 'degraded' ELSE 'allowed' END AS verdict FROM q p LEFT JOIN q b ON p.url = b.url AND b.agent = 'browser' WHERE p.agent <> 'browser'",
    "link_status": f"WITH {_F}, l AS (SELECT DISTINCT scheme || '://' || netloc || h AS url FROM (SELECT scheme, netloc, unnest(hrefs) AS h FROM f)) SELECT url, CASE length(url) % 7 WHEN 2 THEN 'blocked' WHEN 0 THEN 'broken' ELSE 'redirecting' END AS class FROM l",
    "image_weights": f"WITH {_IMAGES} SELECT CASE WHEN broken THEN 'image.broken' ELSE 'image.too_large' END AS code, count(*) AS n FROM w WHERE broken OR bytes > 500000 GROUP BY 1",
    "heavy_images": f"WITH {_IMAGES} SELECT page_id, url, bytes, CAST(0 AS BIGINT) AS skipped FROM w WHERE NOT broken AND bytes > 500000",
    "llms_check": f"WITH {_F}, s AS (SELECT DISTINCT scheme || '://' || netloc AS site FROM u) SELECT site, CASE length(site) % 6 WHEN 0 THEN 'llms.missing' WHEN 5 THEN 'llms.missing' WHEN 4 THEN 'llms.malformed' ELSE 'llms.present' END AS code FROM s",
    "schema_rules": f"SELECT page_id, 'Product' AS type, {_L(','.join(SCHEMA_RULES['Product'][0]))} AS missing, {_L(','.join(SCHEMA_RULES['Product'][1]))} AS lacking FROM pages WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 'BreadcrumbList', '', '' FROM pages WHERE page_id % 5 = 3",
    "remedy_phases": f"WITH d AS (SELECT DISTINCT code, severity FROM ({_DEFECT_SQL})), r(ord, remedy, prefix, cost) AS (VALUES {_RULES}), h AS (SELECT ord, remedy, cost, list_sort(list_distinct(list(code)))[1:8] AS codes, min({_RANK}) AS k FROM d JOIN r ON starts_with(code, prefix) GROUP BY ALL HAVING true) "
    "SELECT CAST(row_number() OVER (ORDER BY k, ord) AS INTEGER) AS phase, remedy, array_to_string(codes, ',') AS codes, ['critical', 'high', 'low', 'info'][k] AS severity, cost FROM h",
    "auditable": f"SELECT page_id, CASE {_N9} WHEN 0 THEN 'challenged' WHEN 1 THEN 'challenged' WHEN 6 THEN 'challenged' WHEN 2 THEN 'error status' WHEN 4 THEN 'not fetched' WHEN 3 THEN 'not html' END AS reason FROM pages",
    "challenge": f"SELECT page_id, CASE {_N9} WHEN 0 THEN 'Cloudflare' WHEN 1 THEN 'Cloudflare' WHEN 6 THEN 'an anti-bot service' END AS vendor, CASE {_N9} WHEN 0 THEN 'cf-mitigated' WHEN 1 THEN '<title>' || chr(10) || 'Just a Moment' WHEN 6 THEN 'captcha' END AS evidence, CASE {_N9} WHEN 0 THEN false WHEN 1 THEN false WHEN 6 THEN true END AS captcha FROM pages",
    "content_type": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN lower(coalesce(lang, 'x')) || '/pdf' WHEN 2 THEN 'text/html' ELSE '' END AS media, CASE WHEN doc_id % 5 IN (0, 2) THEN lower(coalesce(lang, 'x')) END AS charset FROM documents",
    "badge": f"WITH s AS ({_PAGE_SQL['geo_score']}) SELECT page_id, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"' || (length(band) * 6 + length(CAST(score AS VARCHAR)) * 6 + 40) || '\" height=\"20\"><text x=\"10\" y=\"14\">' || band || '</text><text x=\"' || (length(band) * 6 + 30) || '\" y=\"14\">' || score || '</text></svg>' AS svg FROM s",
    "images_extract": "SELECT page_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS pos, unnest(['a.png', 'b.png', 'c.png']) AS src, unnest(['x', NULL, '']) AS alt, unnest([true, false, false]) AS has_size FROM pages WHERE page_id % 3 = 0",
    "hreflang_extract": "SELECT page_id, unnest(['en', 'EN', 'fr']) AS lang, unnest(['/en', '/x', '/fr']) AS href, 'html' AS source FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'de', '/de/' || page_id, 'header' FROM pages WHERE page_id % 4 = 0",
    "hreflang_dups": "SELECT page_id, 'en' AS lang, CAST(2 AS BIGINT) AS n FROM pages WHERE page_id % 3 = 0",
    "readiness_level": f"WITH r AS ({_PAGE_SQL['readiness_pages']}) SELECT level, count(*) AS pages FROM r GROUP BY level",
    "strongest_scores": f"WITH s AS ({_PAGE_SQL['geo_score']}) SELECT page_id, score, (SELECT CAST(greatest(count(*) - {G.STRONGEST}, 0) AS BIGINT) FROM s) AS skipped FROM s ORDER BY score DESC, page_id LIMIT {G.STRONGEST}",
    "links_inbound": "SELECT event_type AS source, count(*) FILTER (event_type <> 'error' AND event_id % 3 > 0) AS found, bool_or(event_type = 'error' OR (event_id % 701 = 0 AND event_type < 'p')) AS unreachable FROM events GROUP BY 1",
    "evidence_runs": "SELECT count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderkey % 3 > 0) AS settled, round(sum(o_orderkey % 8 / 8), 4) AS price FROM orders",
    "envelope_json": f"WITH s AS ({_PAGE_SQL['geo_score']}), r AS (SELECT url, '{{\"score\":' || score || ',\"url\":' || to_json(url) || '}}' AS r FROM s JOIN pages USING (page_id)) SELECT url, '{{\"tool\":{{\"name\":\"geo.score\",\"version\":\"1\"}},\"output_hash\":\"sha256:' || sha256(r) || '\",\"result\":' || r || '}}' AS envelope FROM r",
    "figures_table": "SELECT o_custkey AS page_id, '<table>' || string_agg('<tr><td>' || o_orderstatus || ' &amp; &lt;' || o_orderpriority || '</td><td>&quot;' || o_orderkey % 97 || '%</td></tr>', '' ORDER BY o_orderkey) || '</table>' AS html FROM orders GROUP BY o_custkey",
    "ai_prompts": "SELECT conv_id * 1000 + turn AS ord, sha256(text) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL AND NOT contains(lower(text), 'the')",
}
_EACH = " UNION ALL ".join(f"SELECT {_SITE} AS site, '{c}' AS category, CASE WHEN {_EARNED.get(k, 'false')} THEN {n} ELSE 0 END AS earned, {n} AS points FROM x" for c, keys in _POINTS.items() for k, n in keys.items())
ORACLE_SQL["weakest_categories"] = f"WITH {_F}, {_X}, e AS ({_EACH}), g AS (SELECT site, category, round(sum(earned) / sum(points), 3) AS share FROM e GROUP BY site, category), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY share, category) AS INTEGER) AS place FROM g) SELECT * FROM p WHERE place <= {G.WEAKEST}"
