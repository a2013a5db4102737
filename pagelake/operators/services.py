"""What is left of the audit services: extractions, excerpts, envelopes, artifacts, findings of site files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions.constants import CITATION_BOTS

#: Bodies up to this size are kept inline.
INLINE = 256 << 10


def images(facts: DataFrame) -> DataFrame:
    """(page_id, pos, src, alt, has_size): images in page order."""
    df = facts.select("page_id", F.posexplode("images").alias("pos", "i"))
    sized = (F.coalesce("i.width", F.lit("")) != "") & (F.coalesce("i.height", F.lit("")) != "")
    return df.select("page_id", "pos", "i.src", "i.alt", sized.alias("has_size"))


def hreflangs(facts: DataFrame) -> DataFrame:
    """(page_id, lang, href, source): alternates of the HTML and of the Link header."""
    html = facts.select("page_id", F.explode("hreflangs").alias("h")).select("page_id", "h.lang", "h.href", F.lit("html").alias("source"))
    header = F.coalesce(F.try_element_at(F.col("headers"), F.lit("link")), F.lit(""))
    parts = facts.select("page_id", F.explode(F.split(header, r",\s*(?=<)")).alias("p")).where("p rlike 'hreflang'")
    return html.unionAll(parts.select("page_id", F.regexp_extract("p", 'hreflang="?([^";]+)"?', 1).alias("lang"), F.regexp_extract("p", "<([^>]*)>", 1).alias("href"), F.lit("header").alias("source")))


def duplicate_langs(tags: DataFrame) -> DataFrame:
    return tags.groupBy("page_id", F.lower("lang").alias("lang")).agg(F.count("*").alias("n")).where("n > 1")


def first_paragraph(facts: DataFrame) -> DataFrame:
    p = F.try_element_at(F.filter("paragraphs", lambda x: F.size(T.words(x)) >= 12), F.lit(1))
    return facts.select("page_id", p.alias("lead"), T.word_count(p).alias("words"))


def artifacts(df: DataFrame, key: str, body: str) -> DataFrame:
    """Content-addressed bodies: digest, size in bytes, and the body itself if it is small; equal bodies are one."""
    raw = F.col(body).cast("binary")
    digest = F.sha2(raw, 256)
    g = df.where(F.col(body).isNotNull()).groupBy(digest.alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("uses"), F.any_value(raw).alias("raw"))
    size = F.octet_length("raw")
    return g.select("digest", "first", "uses", size.cast("long").alias("size"), F.when(size <= INLINE, F.replace(F.base64("raw"), F.lit("\r\n"), F.lit(""))).alias("inline"))


def envelope(df: DataFrame) -> DataFrame:
    """df(tool, url, score) -> one JSON envelope a row, with the digest of its result."""
    result = F.to_json(F.struct(F.col("score"), F.col("url")))
    return df.select("url", F.to_json(F.struct(F.struct(F.col("tool").alias("name"), F.lit("1").alias("version")).alias("tool"), F.concat(F.lit("sha256:"), F.sha2(result.cast("binary"), 256)).alias("output_hash"), F.struct("score", "url").alias("result"))).alias("envelope"))


def escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def figures_table(df: DataFrame) -> DataFrame:
    """df(page_id, ord, label, value) -> (page_id, html): one table a page, rows in order."""
    row = F.concat(F.lit("<tr><td>"), escape(F.col("label")), F.lit("</td><td>"), escape(F.col("value")), F.lit("</td></tr>"))
    rows = F.array_sort(F.collect_list(F.struct("ord", row.alias("r"))))
    return df.groupBy("page_id").agg(rows.alias("x")).select("page_id", F.concat(F.lit("<table>"), F.array_join("x.r", ""), F.lit("</table>")).alias("html"))


def robots_findings(verdicts: DataFrame) -> DataFrame:
    """verdicts(site, agent, path, allowed) -> (site, code): agents refused, everyone refused, or all allowed."""
    bot = F.col("agent") != "*"
    g = verdicts.groupBy("site").agg(F.bool_or(bot & ~F.col("allowed")).alias("some"), F.bool_or(~bot & ~F.col("allowed")).alias("everyone"))
    codes = F.array_compact(F.array(F.when(F.col("some"), "robots.ai_disallowed"), F.when(F.col("everyone"), "robots.disallowed"), F.when(~F.coalesce("some", F.lit(False)) & ~F.coalesce("everyone", F.lit(False)), "robots.allowed")))
    return g.select("site", F.explode(codes).alias("code"))


def robots_points(verdicts: DataFrame) -> DataFrame:
    """Points for robots: 13 if all citation agents are allowed, 10 if some, else 0."""
    ours = verdicts.where(F.col("agent").isin(*CITATION_BOTS))
    n = F.count_if("allowed")
    return ours.groupBy("site").agg(F.when(n == F.count("*"), 13).when(n > 0, 10).otherwise(0).alias("points"))


def graph_findings(degrees: DataFrame) -> DataFrame:
    """degrees(node, inbound, outbound) -> (code, n), of all nodes; healthy if there is nothing else."""
    g = degrees.agg(F.count_if(F.col("inbound") == 0).alias("u"), F.count_if(F.col("outbound") == 0).alias("d"))
    codes = F.array_compact(F.array(F.when(F.col("u") > 0, F.struct(F.lit("graph.unlinked").alias("code"), F.col("u").alias("n"))), F.when(F.col("d") > 0, F.struct(F.lit("graph.dead_ends").alias("code"), F.col("d").alias("n"))), F.when((F.col("u") == 0) & (F.col("d") == 0), F.struct(F.lit("graph.healthy").alias("code"), F.lit(0).cast("long").alias("n")))))
    return g.select(F.explode(codes).alias("c")).select("c.*")


def sitemap_findings(diff: DataFrame) -> DataFrame:
    """diff(url, verdict) -> (code, n)."""
    code = F.create_map(*(F.lit(x) for x in ("broken", "sitemap.lists_broken_urls", "noindex", "sitemap.lists_noindex", "not_listed", "sitemap.incomplete", "not_crawled", "sitemap.orphans")))
    return diff.select(F.try_element_at(code, F.col("verdict")).alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))


def questions_without_brand(df: DataFrame) -> DataFrame:
    """df(ord, question, brand): questions that do not name the brand."""
    return df.where(~F.contains(F.lower("question"), F.lower("brand"))).select("ord", "question")


def citations(*sources: DataFrame) -> DataFrame:
    """Sources' rows (source, title, url, error) as one table: what was found, and which could not be reached."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.groupBy("source").agg(F.count_if(F.col("url").isNotNull()).alias("found"), F.bool_or(F.col("error").isNotNull()).alias("unreachable"))


def evidence(runs: DataFrame) -> DataFrame:
    """runs(service, ok, settled, price) -> passes, settlements and the sum of prices."""
    return runs.agg(F.count("*").alias("runs"), F.count_if("ok").alias("passed"), F.count_if("settled").alias("settled"), F.round(F.sum("price"), 4).alias("price"))


def invariants(scores: DataFrame) -> DataFrame:
    """scores(page_id, score, possible): what must hold of every row, as one row of flags."""
    return scores.agg(F.bool_and((F.col("score") >= 0) & (F.col("score") <= 100)).alias("in_range"), F.bool_and(F.col("score") <= F.col("possible")).alias("within_possible"), (F.count("*") == F.count_distinct("page_id")).alias("one_a_page"))
