"""Comparisons, question lists, content audits and figure tables; ranked lists that say what they leave out.

Answers of language models come as recorded rows; what they claim is checked against the text before it is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions.constants import NOT_CHARTABLE

from .services import escape

# Words below which there is nothing to audit, and words of a section that still chunks well.
LEAST_WORDS, SECTION_WORDS = 60, 500
#: Lengths of the lists.
LINKS_PROBED, IMAGES_PROBED, HEAVY, WEAKEST, COMPETITORS, KEYWORDS = 150, 40, 15, 10, 40, 500


def capped(df: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first `most` rows in order, each with how many were left out."""
    total = df.agg(F.count("*").alias("found_"))  # one row
    out = df.orderBy(*order).limit(most).crossJoin(F.broadcast(total))
    return out.withColumn("skipped", F.greatest(F.col("found_") - most, F.lit(0)).cast("long")).drop("found_")


def probe_findings(probes: DataFrame, most: int = LINKS_PROBED) -> DataFrame:
    """probes(page_id, pos, url, internal, status, final_url, error) of pages' links -> (page_id, code, severity, n).

    Links that differ in their fragment alone are one, the first. The first `most` of a page count, and how many more there
    are is a finding; each task hands on `most` of a page at most. Refused ones count as neither broken nor fine;
    links that fail inside the site are worse.
    """
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    own = probes.withColumn("bare_", bare(F.col("url")))
    first = own.groupBy("page_id", "bare_").agg(F.min_by(F.struct("internal", "status", "final_url", "error"), "pos").alias("p"), F.min("pos").alias("pos")).select("page_id", "bare_", "pos", "p.*")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    tried = F.col("error").isNull()
    broken = tried & ((F.col("status") >= 400) | (F.col("status") == 0))
    moved = tried & ~broken & (F.col("status").between(300, 399) | (F.col("final_url").isNotNull() & (bare(F.col("final_url")) != F.col("bare_"))))
    taken = first.withColumn("place_", place).where(F.col("place_") <= most)
    g = taken.groupBy("page_id").agg(F.count_if(broken).alias("b"), F.count_if(broken & F.col("internal")).alias("own"), F.count_if(moved).alias("m"), F.count("*").alias("checked"))
    g = g.join(first.groupBy("page_id").agg(F.count("*").alias("found")), "page_id")
    row = lambda when, code, sev, n: F.when(when, F.struct(F.lit(code).alias("code"), sev.alias("severity"), n.cast("long").alias("n")))
    rows = F.array_compact(F.array(
        row(F.col("b") > 0, "links.broken", F.when(F.col("own") > 0, "critical").otherwise("high"), F.col("b")), row(F.col("m") > 0, "links.redirecting", F.lit("low"), F.col("m")),
        row(F.col("found") > most, "links.truncated", F.lit("info"), F.col("found") - most), row(F.col("b") == 0, "links.all_ok", F.lit("info"), F.col("checked")),
    ))
    return g.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


def questions(rows: DataFrame) -> DataFrame:
    """rows(source, question, url, score, error) -> (question, url, score, sources): what was asked, by score; a missing score is 0.

    Rows with an error contribute nothing. Questions that differ in case or spacing are one.
    """
    key = T.collapse(F.lower("question"))
    good = rows.where(F.col("error").isNull() & (T.collapse(F.col("question")) != "")).withColumn("key_", key).withColumn("score", F.coalesce("score", F.lit(0)))
    best = F.max_by(F.struct("question", "url"), F.struct(F.col("score"), F.col("question"), F.col("url"))).alias("q")
    return good.groupBy("key_").agg(best, F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).select("q.question", "q.url", "score", "sources").orderBy(F.desc("score"), "question")


def unreachable(rows: DataFrame) -> DataFrame:
    """Sources that failed, with the first of their errors: unknown is not none."""
    return rows.where(F.col("error").isNotNull()).groupBy("source").agg(F.min(F.substring("error", 1, 120)).alias("error"))


def compare_sides(citations: DataFrame, presence: DataFrame) -> DataFrame:
    """citations(side, source, url, error), presence(side, crawl, blocks, urls, error) of two sides -> one row of gaps, first side less second.

    The corpus half is withheld if a crawl could not be reached for either side; the citation half stands.
    """
    sides = presence.select("side").unionAll(citations.select("side")).distinct()
    c = citations.groupBy("side").agg(F.count_if(F.col("url").isNotNull() & F.col("error").isNull()).alias("citations"), F.count_if(F.col("error").isNotNull()).alias("lost"))
    p = presence.groupBy("side").agg(F.sum("blocks").alias("blocks"), F.sum("urls").alias("urls"), F.count_if(F.col("error").isNotNull()).alias("down"))
    s = sides.join(c, "side", "left").join(p, "side", "left").fillna(0)
    one = s.agg(F.array_sort(F.collect_list(F.struct("side", "citations", "blocks", "urls", "down", "lost"))).alias("x"))  # two rows
    a, b = F.col("x")[0], F.col("x")[1]
    known = (a["down"] == 0) & (b["down"] == 0)
    return one.select(
        a["side"].alias("ours"), b["side"].alias("theirs"), (a["citations"] - b["citations"]).alias("citation_gap"), F.when(known, a["blocks"] - b["blocks"]).alias("block_gap"),
        F.when(known, a["urls"] - b["urls"]).alias("url_gap"), (~known).alias("corpus_withheld"), (a["lost"] + b["lost"]).alias("sources_lost"),
    )


def audit_content(df: DataFrame) -> DataFrame:
    """df(id, text, answered, quote) -> (id, words, verdict, answered, quote): a quote that the text does not hold is discarded, and without one nothing is answered."""
    n = T.word_count(F.col("text"))
    enough = n >= LEAST_WORDS
    held = enough & F.col("quote").isNotNull() & T.contains_norm(F.col("text"), F.col("quote"))
    verdict = F.when(~enough, "insufficient_content").when(held & F.coalesce("answered", F.lit(False)), "answered").when(enough & F.col("quote").isNotNull() & ~held, "quote_discarded").otherwise("not_answered")
    return df.select("id", n.alias("words"), verdict.alias("verdict"), (held & F.coalesce("answered", F.lit(False))).alias("answered"), F.when(held, F.col("quote")).alias("quote"))


def brief(sections: DataFrame) -> DataFrame:
    """sections(id, heading, covers, words) -> (id, estimated_words, chunkable, complete): a missing number of words is 0."""
    n = F.coalesce("words", F.lit(0))
    full = (F.coalesce("heading", F.lit("")) != "") & (F.coalesce("covers", F.lit("")) != "")
    return sections.groupBy("id").agg(F.sum(n).cast("long").alias("estimated_words"), F.bool_and(n <= SECTION_WORDS).alias("chunkable"), F.bool_and(full).alias("complete"))


def charts(df: DataFrame, labelled: DataFrame) -> DataFrame:
    """df(id, text), labelled(id, ord, label, value, unit) -> (id, detected, chartable, figures, rejected, html, jsonld).

    A figure without a label or value, or whose value the text does not hold, is rejected. Texts without
    a chartable value get no table, whatever was labelled. Figures of a text are in the order of `ord`.
    """
    kinds = F.transform(T.statistics(F.col("text")), T.figure_kind)
    d = df.select("id", "text", F.size(kinds).cast("long").alias("detected"), F.size(F.filter(kinds, lambda k: ~k.isin(*NOT_CHARTABLE))).cast("long").alias("chartable"))
    value, label = F.trim(F.coalesce("value", F.lit(""))), F.trim(F.coalesce("label", F.lit("")))
    j = d.join(labelled, "id", "left").withColumn("ok_", (value != "") & (label != "") & T.contains_norm(F.col("text"), F.col("value")))
    own = F.struct("ord", "label", "value", F.coalesce("unit", F.lit("")).alias("unit"))
    g = j.groupBy("id", "detected", "chartable").agg(F.array_sort(F.collect_list(F.when(F.col("ok_") & (F.col("chartable") > 0), own))).alias("f"), F.count_if(~F.col("ok_") & F.col("ord").isNotNull() & (F.col("chartable") > 0)).alias("rejected"))
    some = F.size("f") > 0
    cell = lambda x: F.concat(F.lit("<td>"), escape(x), F.lit("</td>"))
    rows = F.array_join(F.transform("f", lambda x: F.concat(F.lit("<tr>"), cell(x["label"]), cell(x["value"]), cell(x["unit"]), F.lit("</tr>"))), "")
    head = "<table><caption>Figures stated on this page</caption><thead><tr><th>Measure</th><th>Value</th><th>Unit</th></tr></thead><tbody>"
    measured = F.transform("f", lambda x: F.struct(F.lit("PropertyValue").alias("@type"), x["label"].alias("name"), x["value"].alias("value"), x["unit"].alias("unitText")))
    data = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Dataset").alias("@type"), measured.alias("variableMeasured")))
    return g.select("id", "detected", "chartable", F.size("f").cast("long").alias("figures"), "rejected", F.when(some, F.concat(F.lit(head), rows, F.lit("</tbody></table>"))).alias("html"), F.when(some, data).alias("jsonld"))


def sitemap_report(entries: DataFrame, pages: DataFrame, finished: bool) -> DataFrame:
    """entries(site, kind, loc) of the maps of a site, pages(url, ok, indexable, html) of its crawl -> (code, severity, n).

    Entries that are no http address are malformed. A crawl that stopped early has not shown a listed page to be unreachable.
    """
    told = entries.where(F.col("loc").isNotNull() | (F.col("kind") != "unknown"))
    good = told.where(F.col("loc").rlike("(?i)^https?://[^/]"))
    listed = good.select(F.col("loc").alias("url")).distinct().withColumn("listed", F.lit(True))
    j = listed.join(pages.where("html").select("url", "ok", "indexable", F.lit(True).alias("crawled")), "url", "full_outer")
    inside = F.col("listed") & F.col("crawled")
    g = j.agg(
        F.count_if(inside & ~F.col("ok")).alias("broken"), F.count_if(inside & ~F.col("indexable")).alias("noindex"), F.count_if(F.col("listed").isNull() & F.col("indexable")).alias("absent"), F.count_if(F.col("crawled").isNull()).alias("alone"), F.count_if(F.col("listed")).alias("urls"),
    ).crossJoin(told.agg(F.count("*").alias("maps"), F.count_if(F.col("kind").isin("missing") | ~F.coalesce(F.col("loc").rlike("(?i)^https?://[^/]"), F.lit(False))).alias("bad"))).crossJoin(good.agg(F.count("*").alias("all_")))  # one row each
    row = lambda when, code, sev, n: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), n.cast("long").alias("n")))
    c = F.col
    faults = F.array_compact(F.array(
        row(c("bad") > 0, "sitemap.malformed", "high", c("bad")), row(c("all_") > c("urls"), "sitemap.duplicates", "low", c("all_") - c("urls")), row(c("broken") > 0, "sitemap.lists_broken_urls", "high", c("broken")),
        row(c("noindex") > 0, "sitemap.lists_noindex", "high", c("noindex")), row(c("absent") > 0, "sitemap.incomplete", "low", c("absent")),
        row((c("alone") > 0) & F.lit(finished), "sitemap.orphans", "low", c("alone")), row((c("alone") > 0) & ~F.lit(finished), "sitemap.unverified", "info", c("alone")),
    ))
    none = F.array(F.struct(F.lit("sitemap.missing").alias("code"), F.lit("high").alias("severity"), F.lit(0).cast("long").alias("n")))
    fine = F.array(F.struct(F.lit("sitemap.ok").alias("code"), F.lit("info").alias("severity"), c("urls").cast("long").alias("n")))
    return g.select(F.explode(F.when(c("maps") == 0, none).when(F.size(faults) == 0, fine).otherwise(faults)).alias("r")).select("r.*")
