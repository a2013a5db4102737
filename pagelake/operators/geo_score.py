"""The readiness score: signals of a page with points, their sums by category, total and band.

A page alone gives 58 of 100 points. Signals of site files (robots, llms.txt, discovery files) make up
the other 42; they are left out unless such files were captured: what was not looked at is not 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import urls as U
from pagelake.functions.constants import CITATION_BOTS, OTHER_BOTS

from .site import agent_rules, path_allowed, robots_rules

# Hosts that describe known entities; bands of the total.
KNOWLEDGE = ("wikipedia.org", "wikidata.org", "linkedin.com", "crunchbase.com", "github.com", "twitter.com", "x.com", "facebook.com")
BANDS = ((86, "excellent"), (68, "good"), (36, "foundation"))


def _types() -> Column:
    return F.flatten(F.transform("nodes", lambda n: n["types"]))


def signals() -> list[tuple[str, str, int, Column]]:
    """(category, key, points, whether earned)."""
    good = F.filter("jsonld", lambda j: F.try_parse_json(j).isNotNull())
    has_type = lambda *t: F.arrays_overlap(_types(), F.array(*(F.lit(x) for x in t)))
    props = F.transform("nodes", lambda n: F.size(F.filter(n["props"], lambda k: ~k.startswith("@"))))
    level = lambda *n: F.exists("headings", lambda h: h["level"].isin(*n))
    title = F.coalesce(F.try_element_at(F.col("titles"), F.lit(1)), F.lit(""))
    desc = F.coalesce(F.try_element_at(F.col("descriptions"), F.lit(1)), F.lit(""))
    og = lambda p: F.exists("metas", lambda m: m["property"] == p)
    w = T.words(F.col("body_text"))
    n = F.col("n_words")
    head = F.array_join(F.slice(w, 1, F.greatest(F.lit(1), F.floor(n * 3 / 10).cast("int"))), " ")
    structured = (F.col("lists") > 0) | (F.col("tables") > 0)
    away = F.exists("links", lambda x: x["href"].rlike("^https?://") & (U.netloc(x["href"]) != U.netloc(F.col("url"))))
    tail = F.lower(F.trim(F.try_element_at(F.split(title, r"[|\-–—]", -1), F.lit(-1))))
    names = F.transform(F.filter(good, lambda j: j.rlike(r'"@type"\s*:\s*"(Organization|LocalBusiness|Corporation|WebSite)"')), lambda j: F.lower(F.regexp_extract(j, r'"name"\s*:\s*"([^"]+)"', 1)))
    site = F.transform(F.filter("metas", lambda m: m["property"] == "og:site_name"), lambda m: F.lower(m["content"]))
    told = F.filter(F.concat(site, F.array(tail)), lambda x: x != "")
    agree = F.exists(names, lambda b: (b != "") & F.exists(told, lambda c: F.contains(c, b) | F.contains(b, c)))
    hrefs = F.lower(F.array_join(F.transform("links", lambda x: x["href"]), " "))
    topic = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]{5,}"), F.lit(0))
    heads = F.array_join(F.transform(F.filter("headings", lambda h: h["level"] <= 3), lambda h: h["text"]), " ")
    fresh = F.coalesce(F.map_contains_key("headers", "last-modified"), F.lit(False)) | F.contains("html", F.lit('"dateModified"'))
    return [
        ("schema", "schema_any_valid", 2, F.size("nodes") > 0), ("schema", "schema_richness", 3, F.exists(props, lambda p: p >= 5)),
        ("schema", "schema_faq", 3, has_type("FAQPage")), ("schema", "schema_article", 3, has_type("Article", "NewsArticle", "BlogPosting")),
        ("schema", "schema_organization", 3, has_type("Organization", "LocalBusiness", "Corporation")), ("schema", "schema_website", 2, has_type("WebSite")),
        ("meta", "meta_title", 5, title != ""), ("meta", "meta_description", 2, desc != ""), ("meta", "meta_canonical", 3, F.size("canonicals") > 0),
        ("meta", "meta_og", 4, og("og:title") & og("og:description")),
        ("content", "content_h1", 2, level(1)), ("content", "content_numbers", 1, F.col("n_statistics") > 0), ("content", "content_links", 1, away),
        ("content", "content_word_count", 2, n >= 300), ("content", "content_heading_hierarchy", 2, level(2) & level(3)),
        ("content", "content_lists_or_tables", 2, structured), ("content", "content_front_loading", 2, (n > 0) & (structured | (F.size(T.statistics(head)) > 0))),
        ("signals", "signals_lang", 3, F.coalesce("lang", F.lit("")) != ""), ("signals", "signals_rss", 2, F.col("html").rlike(r'(?i)<link[^>]*type="?[^">]*(rss|atom)')), ("signals", "signals_freshness", 1, fresh),
        ("brand", "brand_entity_coherence", 3, agree), ("brand", "brand_kg_readiness", 3, F.exists(good, lambda j: F.contains(j, F.lit('"sameAs"')) & j.rlike("|".join(k.replace(".", r"\.") for k in KNOWLEDGE)))),
        ("brand", "brand_about_contact", 2, hrefs.rlike(r"/(about|about-us|company|team)\b") & hrefs.rlike(r"/(contact|contact-us|support)\b")),
        ("brand", "brand_geo_identity", 1, has_type("LocalBusiness", "PostalAddress", "Place") | F.exists(good, lambda j: F.contains(j, F.lit('"address"')))),
        ("brand", "brand_topic_authority", 1, ((tail != "") | (F.size(names) > 0)) & F.arrays_overlap(topic(heads), topic(F.concat(title, F.lit(" "), desc)))),
    ]


def geo_signals(facts: DataFrame) -> DataFrame:
    """(page_id, category, key, points, earned): one row a page and signal."""
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(k).alias("key"), F.lit(p).alias("points"), F.when(F.coalesce(e, F.lit(False)), p).otherwise(0).alias("earned")) for c, k, p, e in signals()))
    return facts.select("page_id", F.explode(rows).alias("s")).select("page_id", "s.*")


#: Kinds of site files, and the points of each discovery file that is there (and is JSON where it must be).
_DISCOVERY = (("ai_discovery_well_known", "well_known", 2, False), ("ai_discovery_summary", "summary", 2, True), ("ai_discovery_faq", "faq", 1, True), ("ai_discovery_service", "service", 1, True))


def site_signals(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(page_id, category, key, points, earned) of the files of each page's site.

    pages(page_id, url); files(site, kind, body): site is scheme://host, kind one of robots, llms,
    llms_full, well_known, summary, faq and service; a file that is not there has no row. Without a
    robots file everyone is allowed in; with one, agents count by the rule for the page's own path.
    """
    root = F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url")))
    p = pages.select("page_id", root.alias("site"), F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url"))).alias("path"))
    body = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("body")))
    per = files.groupBy("site").agg(*(body(k).alias(k) for k in ("robots", "llms", "llms_full", "well_known", "summary", "faq", "service")))
    bots = F.array(*(F.struct(F.lit(b).alias("agent"), F.lit(b in CITATION_BOTS).alias("cites")) for b in (*CITATION_BOTS, *OTHER_BOTS)))
    robots = files.where("kind = 'robots'")
    asked = robots.select("site").distinct().withColumn("b", F.explode(bots)).select("site", "b.agent", "b.cites")
    # a row a site with the rules of each agent; pages meet it by their site
    own = agent_rules(robots_rules(robots), asked).join(asked, ["site", "agent"]).groupBy("site").agg(F.collect_list(F.struct("cites", "patterns")).alias("agents"))
    let_in = lambda a: path_allowed(a["patterns"], F.col("path"))
    df = p.join(per, "site", "left").join(own, "site", "left")
    df = df.withColumn("in_", F.filter("agents", let_in)).withColumn("in_all", F.size("in_")).withColumn("citing", F.size(F.filter("in_", lambda a: a["cites"]))).drop("in_", "agents")
    has = lambda k: F.coalesce(F.col(k), F.lit("")) != ""
    llms = F.coalesce("llms", F.lit(""))
    rx = lambda r: llms.rlike(r)
    n = T.word_count(llms)
    some = F.col("robots").isNotNull() & (F.col("citing") < len(CITATION_BOTS)) & (F.col("in_all") > 0)
    open_ = F.col("robots").isNull() | (F.col("citing") == len(CITATION_BOTS))
    there = F.col("llms").isNotNull()
    row = lambda c, k, pts, earned: F.struct(F.lit(c).alias("category"), k.alias("key") if isinstance(k, Column) else F.lit(k).alias("key"), F.lit(pts).alias("points"), earned.cast("int").alias("earned"))
    when = lambda c, pts: F.when(c, pts).otherwise(0)
    rows = [
        row("robots.txt", "robots_found", 5, when(F.col("robots").isNotNull(), 5)),
        row("robots.txt", F.when(some, "robots_some_allowed").otherwise("robots_citation_ok"), 13, F.when(open_, 13).when(some, 10).otherwise(0)),
        row("llms.txt", "llms_found", 5, when(there, 5)), row("llms.txt", "llms_h1", 2, when(rx(r"(?m)^#\s+\S"), 2)), row("llms.txt", "llms_blockquote", 1, when(rx(r"(?m)^>\s+\S"), 1)),
        row("llms.txt", "llms_sections", 2, when(rx(r"(?m)^##\s+\S"), 2)), row("llms.txt", "llms_links", 2, when(rx(r"\]\((https?://[^)]+)\)"), 2)),
        row("llms.txt", "llms_depth", 2, when(n >= 1000, 2)), row("llms.txt", "llms_depth_high", 2, when(n >= 5000, 2)), row("llms.txt", "llms_full", 2, when(there & has("llms_full"), 2)),
        *(row("ai_discovery", key, pts, when(has(kind) & (F.try_parse_json(F.col(kind)).isNotNull() if parses else F.lit(True)), pts)) for key, kind, pts, parses in _DISCOVERY),
    ]
    return df.select("page_id", F.explode(F.array(*rows)).alias("s")).select("page_id", "s.*")


def band(total: Column) -> Column:
    out = F.when(F.lit(False), "")
    for least, name in BANDS:
        out = out.when(total >= least, name)
    return out.otherwise("critical")


def geo_score(signals_: DataFrame) -> DataFrame:
    total = F.least(F.sum("earned"), F.lit(100))
    return signals_.groupBy("page_id").agg(total.cast("long").alias("score"), F.sum("points").cast("long").alias("possible")).withColumn("band", band(F.col("score")))


def readiness_level(signals_: DataFrame) -> DataFrame:
    """none, basic, ready or advanced, from the keys that earned points."""
    got = signals_.groupBy("page_id").agg(F.collect_set(F.when(F.col("earned") > 0, F.col("key"))).alias("k"))
    has = lambda x: F.array_contains("k", x)
    all_ = has("ai_discovery_well_known") & has("ai_discovery_summary") & has("ai_discovery_faq")
    level = F.when(all_ & has("llms_depth") & has("schema_richness"), "advanced").when(all_, "ready").when(has("ai_discovery_well_known") | has("ai_discovery_summary"), "basic").otherwise("none")
    return got.select("page_id", level.alias("level"))


#: Lengths of the lists of a site's categories and of its strongest pages.
WEAKEST, STRONGEST = 3, 5


def weakest_categories(signals_: DataFrame, most: int = WEAKEST) -> DataFrame:
    """signals(site, category, points, earned) -> (site, category, share, place): the categories in which a site earns the least share of its points, ties by name."""
    g = signals_.groupBy("site", "category").agg(F.round(F.sum("earned") / F.sum("points"), 3).alias("share"))
    place = F.row_number().over(Window.partitionBy("site").orderBy("share", "category"))
    return g.withColumn("place", place).where(F.col("place") <= most)
