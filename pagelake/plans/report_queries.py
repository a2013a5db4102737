"""Ranked lists, comparisons, question lists, audits and figure tables, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import urls as U
from pagelake.functions.constants import INTENTS, WS
from pagelake.operators import market as M
from pagelake.operators import page_checks as C
from pagelake.operators import reports as R
from pagelake.operators import services as V
from pagelake.operators import site as S

from .fixtures import literal
from .page_queries import _F, _G, _LINK, _pages, _prepared, damaged, geo_score, links_extract, page_facts, site_files
from .text_queries import _KIND, _ORDER_TEXT, _W, NOT_CHARTABLE, _figures, _found, _t


def weakest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.capped(page_facts(spark, sf_dir).select("page_id", "words"), R.WEAKEST, F.asc("words"), F.asc("page_id"))


def weakest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.capped(geo_score(spark, sf_dir).select("page_id", "score"), R.WEAKEST, F.asc("score"), F.asc("page_id"))


def worst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest groups of pages that share a language, with the first of their addresses."""
    p = _prepared(spark, sf_dir, "lang").select("url", "lang", "media_type", "ok", F.lit(None).cast("string").alias("robots"))
    return S.duplicate_groups(p, "lang", S.WORST).withColumn("sample", F.array_join("sample", ","))


def _answered(links: DataFrame) -> DataFrame:
    """Links as if probed: what came back follows from the length of the address."""
    n = F.length("url") % 7
    status = F.when(n == 0, 404).when(n == 1, 301).otherwise(200)
    return links.withColumns({"status": status, "final_url": F.when(n == 3, F.concat("url", F.lit("/x"))).otherwise(F.concat("url", F.lit("#x"))), "error": F.when(n == 2, "refused")})


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link target of the pages, probed."""
    return _answered(links_extract(spark, sf_dir).select("url").distinct().withColumn("internal", F.lit(True)))


#: Links of a page that are probed in the test.
_FEW = 4


def links_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the first links of each page, and how many were left out."""
    return R.probe_findings(_answered(links_extract(spark, sf_dir).select("page_id", "pos", "url", "internal")), _FEW)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users ask in conversations, as questions of three archives, one of which fails now and then."""
    c = _t(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return c.select(
        F.concat(F.lit("archive"), (F.col("conv_id") % 3).cast("string")).alias("source"), F.col("text").alias("question"), F.concat(F.lit("https://q.test/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("url"),
        F.when(F.col("conv_id") % 11 != 0, F.length("text") % 50).cast("long").alias("score"), F.when(F.col("conv_id") % 17 == 0, F.concat(F.lit("timeout "), F.col("conv_id").cast("string"))).alias("error"),
    )


def question_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.questions(_asked(spark, sf_dir))


def question_sources_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unreachable(_asked(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str, lost: int | None) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    side = F.when(F.col("o_orderkey") % 2 == 0, "a.test").otherwise("b.test")
    down = (F.col("o_orderkey") % 2 == 1) & (F.col("o_orderpriority") == "5-LOW")
    c = o.select(side.alias("side"), F.col("o_orderpriority").alias("source"), F.when(~down, F.col("o_orderkey").cast("string")).alias("url"), F.when(down, "timeout").alias("error"))
    crawl = F.year("o_orderdate")
    p = o.groupBy(side.alias("side"), crawl.alias("crawl")).agg(F.sum(F.col("o_custkey").cast("long")).alias("blocks"), F.count("*").alias("urls"))
    gone = (F.col("crawl") == lost) & (F.col("side") == "b.test") if lost else F.lit(False)
    return R.compare_sides(c, p.withColumn("error", F.when(gone, "timeout")))


#: Brands, each with the names it goes by, and an address.
BRANDS = (("a", ("x", "zzz none", "tion be", "the"), "a.test"), ("b", ("That", "of the"), ""), ("c", ("never named",), "And "))


def mention_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the answers of all conversations name their brand, a third of them each."""
    c = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    brand = F.element_at(F.array(*(F.lit(b) for b, *_ in BRANDS)), (F.col("conv_id") % len(BRANDS) + 1).cast("int"))
    brands = spark.createDataFrame([(b, list(a), h) for b, a, h in BRANDS], "brand string, aliases array<string>, host string")
    out = M.mention_evidence(c.select(F.struct("conv_id", "turn").alias("id"), brand.alias("brand"), "text"), brands)
    return out.select("id.conv_id", "id.turn", "brand", "matched", "position", F.regexp_replace("context", r"\s+", " ").alias("context"))


def links_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir, None)


def links_compare_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir, 1997)


def content_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a quote of twelve of its words, every third time spelled backwards."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.array_join(F.slice(T.words(F.col("text")), 10, 12), " ").alias("q"))
    quote = F.when(F.col("q") != "", F.when(F.col("id") % 3 == 0, F.reverse("q")).otherwise(F.col("q")))
    return R.audit_content(d.select("id", "text", (F.col("id") % 2 == 0).alias("answered"), quote.alias("quote")))


def content_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return R.brief(o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("heading"), F.when(F.col("o_orderkey") % 13 != 0, "what it covers").otherwise("").alias("covers"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 510).cast("int").alias("words")))


def content_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures stated of each order, as labelled by a reader that makes one up and forgets a label."""
    f = _figures(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "text")
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit("%")).alias("rise"), F.concat(F.lit("$"), F.floor("o_totalprice").cast("bigint").cast("string")).alias("total"))
    row = lambda n, label, value, unit: F.struct(F.lit(n), F.lit(label), value, F.lit(unit).cast("string")).cast("struct<ord:int,label:string,value:string,unit:string>")
    said = F.array(row(2, "rise & fall", F.col("rise"), "percent"), row(1, "total", F.col("total"), None), row(3, "made up", F.lit("987654321987%"), "percent"), row(4, " ", F.col("rise"), "percent"))
    return R.charts(f, o.select("id", F.explode(said).alias("s")).select("id", "s.*"))


def sitemap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a crawl, and a sitemap that leaves some out, repeats some and lists some that are not there."""
    p = _pages(spark, sf_dir)
    m = lambda k, r: F.col("page_id") % k == r
    locs = F.array_compact(F.array(F.when(~m(3, 0), F.col("url")), F.when(m(10, 1), F.col("url")), F.when(m(25, 3), "ftp://files"), F.when(m(20, 7), F.concat("url", F.lit("/gone")))))
    entries = p.select(F.lit("s").alias("site"), F.lit("urlset").alias("kind"), F.explode(locs).alias("loc"))
    pages = p.groupBy("url").agg(F.min("page_id").alias("page_id")).select("url", (~m(8, 0)).alias("ok"), (~m(8, 0) & ~m(9, 0)).alias("indexable"), F.lit(True).alias("html"))
    return R.sitemap_report(entries, pages, True)


_PHRASES = ("buy shoes", "best crm", "how to mend", "login page", "red paint", "price of oil", "review of it", "what is it", "Docs for x", "HIRE a man", "versus", "")


def intent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the intent of phrases that stand for them."""
    n = (F.col("o_orderkey") % len(_PHRASES) + 1).cast("int")
    p = F.concat(F.element_at(F.array(*(F.lit(x) for x in _PHRASES)), n), F.lit(" "), F.lower(F.substring("o_orderpriority", 3, 20)))
    return _t(spark, sf_dir, "orders").groupBy(M.intent(p).alias("intent")).agg(F.count("*").alias("n"), F.count_distinct(p).alias("phrases"))


def suggestions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of engines that fail now and then: the type of an event is the engine, the user the phrase."""
    e = _t(spark, sf_dir, "events")
    phrase = F.concat(F.when(F.col("user_id") % 2 == 0, "CRM  for ").otherwise("crm  for "), (F.col("user_id") % 25).cast("string"))
    s = e.select(F.col("event_type").alias("engine"), F.lit("crm").alias("variation"), phrase.alias("phrase"), F.when(F.col("event_id") % 13 == 0, "timeout").alias("error"))
    return M.merge_suggestions(s, "crm").select("phrase", F.array_join("sources", ",").alias("sources"), "seen")


def images_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.images(C.prepared(C.captured(damaged(_pages(spark, sf_dir))), ("images",)))


def hreflangs_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hreflangs(C.prepared(C.captured(damaged(_pages(spark, sf_dir))), ("hreflangs",)))


def robots_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two agents may read each page, by the robots file of its site."""
    url = F.col("url")
    site = F.concat(U.scheme(url), F.lit("://"), U.netloc(url))
    asked = _pages(spark, sf_dir).select(site.alias("site"), F.when(U.path(url) == "", "/").otherwise(U.path(url)).alias("path")).distinct().withColumn("agent", F.explode(F.array(F.lit("ClaudeBot"), F.lit("GPTBot"))))
    return S.robots_verdict(S.robots_rules(site_files(spark, sf_dir).where("kind = 'robots'").select("site", "body")), asked)


QUERIES = {f.__name__: f for f in (weakest_pages, weakest_scores, worst_groups, links_probed, question_list, question_sources_lost, mention_evidence, links_compare, links_compare_withheld, content_audit, content_brief, content_charts, sitemap_report, intent_orders, suggestions_merged, images_of_pages, hreflangs_of_pages, robots_of_pages)}

_Q = f"""q AS (SELECT 'archive' || conv_id % 3 AS source, text AS question, 'https://q.test/' || conv_id || '/' || turn AS url, CASE WHEN conv_id % 11 <> 0 THEN length(text) % 50 END AS score, CASE WHEN conv_id % 17 = 0 THEN 'timeout ' || conv_id END AS error FROM conversations WHERE role = 'user' AND text IS NOT NULL),
k AS (SELECT source, question, url, coalesce(score, 0) AS score, trim(regexp_replace(lower(question), '{WS}', ' ', 'g')) AS key FROM q WHERE error IS NULL AND trim(regexp_replace(question, '{WS}', ' ', 'g')) <> '')"""


def _compared(lost: int | None) -> str:
    gone = f"(crawl = {lost} AND side = 'b.test')" if lost else "false"
    return f"""WITH o AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a.test' ELSE 'b.test' END AS side, o_orderkey % 2 = 1 AND o_orderpriority = '5-LOW' AS down, year(o_orderdate) AS crawl, o_custkey FROM orders),
s AS (SELECT side, count(*) FILTER (NOT down) AS c, count(*) FILTER (down) AS lost, CAST(sum(o_custkey) AS BIGINT) AS blocks, count(*) AS urls, bool_or({gone}) AS gone FROM o GROUP BY side)
SELECT a.side AS ours, b.side AS theirs, a.c - b.c AS citation_gap, CASE WHEN NOT b.gone THEN a.blocks - b.blocks END AS block_gap, CASE WHEN NOT b.gone THEN a.urls - b.urls END AS url_gap, b.gone AS corpus_withheld, a.lost + b.lost AS sources_lost FROM s a, s b WHERE a.side = 'a.test' AND b.side = 'b.test'"""


def _mentions() -> str:
    def place(alias: str) -> str:
        rx = f"'(?i)\\b{alias}\\b'"
        return f"CASE WHEN regexp_matches(text, {rx}) THEN length(string_split_regex(text, {rx})[1]) END"

    parts = []
    for i, (brand, aliases, host) in enumerate(BRANDS):
        known = [a for a in aliases if len(a) > 1]
        matched = "CASE " + " ".join(f"WHEN {place(a)} IS NOT NULL THEN '{a}'" for a in known) + " END"
        at = f"coalesce({', '.join(map(place, known))}, NULL)"
        by_host = f"CASE WHEN contains(lower(text), '{host.lower()}') THEN position('{host.lower()}' IN lower(text)) - 1 END" if host else "NULL"
        parts.append(f"SELECT conv_id, turn, '{brand}' AS brand, text, {matched} AS a, {at} AS p, {by_host} AS h, '{host}' AS host FROM conversations WHERE role = 'assistant' AND conv_id % {len(BRANDS)} = {i}")
    strip = "regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    sentence = "regexp_extract(text[1:p], '[^.]*$') || text[p + 1:p + length(a)] || regexp_extract(text[p + length(a) + 1:], '^[^.]*[.]?')"
    return (
        f"WITH m AS ({' UNION ALL '.join(parts)}) SELECT conv_id, turn, brand, coalesce(a, host) AS matched, CAST(coalesce(p, h) AS BIGINT) AS position, "
        f"CASE WHEN p IS NOT NULL THEN regexp_replace(regexp_replace({sentence}, '^\\s+|\\s+$', '', 'g')[1:300], '\\s+', ' ', 'g') ELSE {strip.format('text[greatest(h - 120, 0) + 1:h + 120]')} END AS context FROM m WHERE p IS NOT NULL OR h IS NOT NULL"
    )


_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_KINDS = f"list_transform({_found('text')}, lambda token: {_KIND})"
_ROW = "'<tr><td>' || {} || '</td><td>' || {} || '</td><td>' || {} || '</td></tr>'"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(p, {literal(rx)}) THEN {literal(k)}" for k, rx in INTENTS) + " ELSE 'informational' END"
ORACLE_SQL = {
    "intent_orders": f"WITH t AS (SELECT {literal(list(_PHRASES))}[o_orderkey % {len(_PHRASES)} + 1] || ' ' || lower(substr(o_orderpriority, 3, 20)) AS p FROM orders) SELECT {_INTENT} AS intent, count(*) AS n, count(DISTINCT p) AS phrases FROM t GROUP BY 1",
    "suggestions_merged": "SELECT 'crm for ' || user_id % 25 AS phrase, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, count(*) AS seen FROM events WHERE event_id % 13 <> 0 GROUP BY 1",
    "images_of_pages": "SELECT page_id, 0 AS pos, 'a.bmp' AS src, NULL AS alt, false AS has_size FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 0, 'b.png', '', true FROM pages WHERE page_id % 4 = 2",
    "hreflangs_of_pages": "SELECT page_id, 'en_US' AS lang, '/x' AS href, 'html' AS source FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'fr', '', 'html' FROM pages WHERE page_id % 5 = 0",
    "robots_of_pages": f"WITH {_F}, q AS (SELECT DISTINCT scheme || '://' || netloc AS site, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM u), a AS (SELECT *, unnest(['ClaudeBot', 'GPTBot']) AS agent FROM q) SELECT site, agent, path, CASE length(site) % 5 WHEN 2 THEN agent <> 'ClaudeBot' WHEN 3 THEN false WHEN 4 THEN NOT starts_with(path, '/en/') ELSE true END AS allowed FROM a",
    "weakest_pages": f"WITH {_F} SELECT page_id, CAST(words AS BIGINT) AS words, (SELECT CAST(greatest(count(*) - {R.WEAKEST}, 0) AS BIGINT) FROM f) AS skipped FROM f ORDER BY words, page_id LIMIT {R.WEAKEST}",
    "weakest_scores": f"WITH {_F}, {_G} SELECT page_id, score, (SELECT CAST(greatest(count(*) - {R.WEAKEST}, 0) AS BIGINT) FROM g) AS skipped FROM g ORDER BY score, page_id LIMIT {R.WEAKEST}",
    "worst_groups": f"WITH l AS (SELECT url, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS value FROM pages), n AS (SELECT value, count(*) AS pages FROM l WHERE value <> '' GROUP BY value HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT {S.WORST}) SELECT value, pages, array_to_string((SELECT list(url ORDER BY url) FROM (SELECT DISTINCT url FROM l WHERE l.value = n.value))[1:{S.SAMPLE}], ',') AS sample FROM n",
    "links_probed": f"WITH {_F}, {_LINK}, d AS (SELECT page_id, link, min(pos) AS pos, length(link) % 7 AS n FROM l GROUP BY page_id, link), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM d), g AS (SELECT page_id, count(*) FILTER (n = 0 AND k <= {_FEW}) AS b, count(*) FILTER (n IN (1, 3) AND k <= {_FEW}) AS m, count(*) FILTER (k <= {_FEW}) AS c, count(*) - {_FEW} AS t FROM o GROUP BY page_id) "
    f"SELECT * FROM (SELECT page_id, 'links.broken' AS code, 'critical' AS severity, b AS n FROM g UNION ALL SELECT page_id, 'links.redirecting', 'low', m FROM g UNION ALL SELECT page_id, 'links.truncated', 'info', t FROM g UNION ALL SELECT page_id, 'links.all_ok', 'info', CASE WHEN b = 0 THEN c ELSE 0 END FROM g) WHERE n > 0",
    "question_list": f"WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, question DESC, url DESC) AS i FROM k), s AS (SELECT key, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM k GROUP BY key) SELECT question, url, score, sources FROM r JOIN s USING (key) WHERE i = 1",
    "question_sources_lost": f"WITH {_Q} SELECT source, min(substr(error, 1, 120)) AS error FROM q WHERE error IS NOT NULL GROUP BY source",
    "mention_evidence": _mentions(), "links_compare": _compared(None), "links_compare_withheld": _compared(1997),
    "content_audit": f"WITH w AS (SELECT doc_id AS id, text, {_W} AS w FROM documents), q AS (SELECT *, array_to_string(w[10:21], ' ') AS q FROM w), r AS (SELECT *, CASE WHEN q <> '' THEN CASE WHEN id % 3 = 0 THEN reverse(q) ELSE q END END AS quote FROM q), "
    f"n AS (SELECT *, {_N.format('coalesce(text, chr(32))')} AS h, {_N.format('coalesce(quote, chr(32))')} AS n FROM r), c AS (SELECT *, len(w) >= {R.LEAST_WORDS} AND quote IS NOT NULL AND n <> '' AND (contains(h, n) OR len(string_split(n, ' ')) > 12 AND contains(h, array_to_string(string_split(n, ' ')[1:12], ' '))) AS held FROM n) "
    f"SELECT id, CAST(len(w) AS BIGINT) AS words, CASE WHEN len(w) < {R.LEAST_WORDS} THEN 'insufficient_content' WHEN held AND id % 2 = 0 THEN 'answered' WHEN quote IS NOT NULL AND NOT held THEN 'quote_discarded' ELSE 'not_answered' END AS verdict, held AND id % 2 = 0 AS answered, CASE WHEN held THEN quote END AS quote FROM c",
    "content_brief": f"SELECT o_custkey AS id, CAST(sum(w) AS BIGINT) AS estimated_words, bool_and(w <= {R.SECTION_WORDS}) AS chunkable, bool_and(o_orderkey % 13 <> 0) AS complete FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 510 ELSE 0 END AS w FROM orders) GROUP BY o_custkey",
    "content_charts": f"WITH t AS (SELECT o_orderkey AS id, {_ORDER_TEXT} AS text, o_orderkey % 97 || '%' AS rise, '$' || CAST(floor(o_totalprice) AS BIGINT) AS total FROM orders), k AS (SELECT *, {_KINDS} AS kinds FROM t), c AS (SELECT *, len(kinds) AS detected, len(list_filter(kinds, lambda x: x NOT IN {NOT_CHARTABLE})) AS chartable FROM k) "
    f"SELECT id, CAST(detected AS BIGINT) AS detected, CAST(chartable AS BIGINT) AS chartable, CAST(CASE WHEN chartable > 0 THEN 2 ELSE 0 END AS BIGINT) AS figures, CAST(CASE WHEN chartable > 0 THEN 2 ELSE 0 END AS BIGINT) AS rejected, CASE WHEN chartable > 0 THEN '<table><caption>Figures stated on this page</caption><thead><tr><th>Measure</th><th>Value</th><th>Unit</th></tr></thead><tbody>' || {_ROW.format(chr(39) + 'total' + chr(39), 'total', chr(39) * 2)} || {_ROW.format(chr(39) + 'rise &amp; fall' + chr(39), 'rise', chr(39) + 'percent' + chr(39))} || '</tbody></table>' END AS html, "
    """CASE WHEN chartable > 0 THEN '{"@context":"https://schema.org","@type":"Dataset","variableMeasured":[{"@type":"PropertyValue","name":"total","value":"' || total || '","unitText":""},{"@type":"PropertyValue","name":"rise & fall","value":"' || rise || '","unitText":"percent"}]}' END AS jsonld FROM c""",
    "sitemap_report": "WITH p AS (SELECT url, min(page_id) AS i FROM pages GROUP BY url), e AS (SELECT url AS loc FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT url FROM pages WHERE page_id % 10 = 1 UNION ALL SELECT url || '/gone' FROM pages WHERE page_id % 20 = 7), d AS (SELECT DISTINCT loc FROM e), j AS (SELECT loc, i, i % 8 <> 0 AS ok, i % 8 <> 0 AND i % 9 <> 0 AS fine FROM d FULL JOIN p ON loc = url) "
    "SELECT * FROM (SELECT 'sitemap.malformed' AS code, 'high' AS severity, (SELECT count(*) FROM pages WHERE page_id % 25 = 3) AS n UNION ALL SELECT 'sitemap.duplicates', 'low', (SELECT count(*) FROM e) - (SELECT count(*) FROM d) UNION ALL SELECT 'sitemap.lists_broken_urls', 'high', count(*) FROM j WHERE loc IS NOT NULL AND NOT ok "
    "UNION ALL SELECT 'sitemap.lists_noindex', 'high', count(*) FROM j WHERE loc IS NOT NULL AND NOT fine UNION ALL SELECT 'sitemap.incomplete', 'low', count(*) FROM j WHERE loc IS NULL AND fine UNION ALL SELECT 'sitemap.orphans', 'low', count(*) FROM j WHERE i IS NULL) WHERE n > 0",
}
