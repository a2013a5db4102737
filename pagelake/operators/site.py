"""Cross-page checks and the link graph, over crawl_pages and link_edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import urls as U
from pagelake.sources.tables import cut

MAX_DEPTH = 4
CRAWL_DEPTH = 5
SAMPLE = 12
LINKERS = 6
WORST = 5
DAMPING = 0.85
ROUNDS = 30
RANKED = 15


def indexable(pages: DataFrame) -> Column:
    return (F.col("media_type") == "text/html") & F.col("ok") & ~F.contains(F.lower(F.coalesce("robots", F.lit(""))), F.lit("noindex"))


def _first(df: DataFrame, key: str, value: str, most: int, name: str) -> DataFrame:
    """(key, name): the first `most` distinct values of each key in order; no task holds more of a key than that."""
    w = Window.partitionBy(key).orderBy(value)
    top = df.select(key, value).distinct().withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= most)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def duplicate_groups(pages: DataFrame, col: str, most: int | None = None) -> DataFrame:
    """(value, pages, sample): values that more than one indexable page has, or the `most` largest groups of them."""
    v = F.trim(F.coalesce(F.col(col), F.lit("")))
    g = pages.where(indexable(pages)).select(v.alias("value"), "url").where("value <> ''")
    groups = g.groupBy("value").agg(F.count("*").alias("pages")).where("pages > 1")
    groups = groups if most is None else groups.orderBy(F.desc("pages"), "value").limit(most)
    return groups.join(_first(g.join(groups.select("value"), "value", "left_semi"), "value", "url", SAMPLE, "sample"), "value").select("value", "pages", "sample")


def orphans(pages: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    return pages.where(F.col("url") != start).join(edges.select(F.col("dst").alias("url")), "url", "left_anti").select("url")


def canonical_conflicts(pages: DataFrame) -> DataFrame:
    """(url, target, conflict): error before redirect before noncanonical before nonindexable."""
    t = pages.select(F.col("url").alias("target"), F.col("status").alias("t_status"), F.col("canonical").alias("t_canonical"), F.lower(F.coalesce("robots", F.lit(""))).alias("t_robots"), F.size("redirect_chain").alias("t_hops"))
    j = pages.where(F.col("canonical").isNotNull() & (F.col("canonical") != "") & (F.col("canonical") != F.col("url"))).join(t, F.col("canonical") == F.col("target"))
    kind = (
        F.when(F.col("t_status") >= 400, "error").when((F.col("t_hops") > 1) | F.col("t_status").between(300, 399), "redirect")
        .when(F.col("t_canonical").isNotNull() & (F.col("t_canonical") != "") & (F.col("t_canonical") != F.col("target")), "noncanonical").when(F.contains("t_robots", F.lit("noindex")), "nonindexable")
    )
    return j.select("url", "target", kind.alias("conflict")).where("conflict IS NOT NULL")


def hreflang_targets(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("url").alias("src"), F.explode("hreflangs").alias("h")).select("src", F.col("h.url").alias("dst"), F.col("h.lang").alias("lang")).where("src <> dst")


def hreflang_broken(pages: DataFrame) -> DataFrame:
    t = pages.select(F.col("url").alias("dst"), "status", indexable(pages).alias("fine"))
    j = hreflang_targets(pages).join(t, "dst")
    return j.select("src", "dst", F.when((F.col("status") >= 400) | (F.col("status") == 0), "error").when(~F.col("fine"), "nonindexable").alias("problem")).where("problem IS NOT NULL")


def hreflang_return(pages: DataFrame) -> DataFrame:
    """Alternates that were fetched well and do not link back."""
    h = hreflang_targets(pages).select("src", "dst").distinct()
    known = h.join(pages.where("ok").select(F.col("url").alias("dst")), "dst", "left_semi")
    back = h.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return known.join(back, ["src", "dst"], "left_anti").select("src", "dst")


def follow_signals(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst, signal): indexable targets of nofollow links only, or of both kinds."""
    good = pages.where(F.col("ok") & ~F.contains(F.lower(F.coalesce("robots", F.lit(""))), F.lit("noindex"))).select(F.col("url").alias("dst"))
    g = edges.groupBy("dst").agg(F.bool_and("nofollow").alias("only"), F.bool_or("nofollow").alias("some"))
    only = g.where("only").join(good, "dst", "left_semi").select("dst", F.lit("nofollow_only").alias("signal"))
    return only.unionAll(g.where("some AND NOT only").select("dst", F.lit("mixed").alias("signal")))


def broken_links(pages: DataFrame, edges: DataFrame) -> DataFrame:
    bad = pages.where(F.col("status") >= 400).select("url", "status")
    edges = edges.where("inbound") if "inbound" in edges.columns else edges
    to = edges.select(F.col("dst").alias("url"), "src").join(bad.select("url"), "url", "left_semi")
    froms = _first(to, "url", "src", LINKERS, "linked_from")
    return bad.join(froms, "url", "left").select("url", "status", F.coalesce("linked_from", F.array().cast("array<string>")).alias("linked_from"))


def redirect_problems(pages: DataFrame) -> DataFrame:
    n = F.size("redirect_chain")
    return pages.select("url", F.when(F.size(F.array_distinct("redirect_chain")) < n, "loop").when(n > 2, "chain").alias("problem")).where("problem IS NOT NULL")


def crawl_summary(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.count("*").alias("pages"), F.count_if("ok").alias("ok"), F.count_if(F.col("status") >= 400).alias("errors"), F.count_if(indexable(pages)).alias("indexable"), F.max("depth").alias("max_depth"),
    )


def crawl_pages(facts: DataFrame) -> DataFrame:
    """Facts of captured pages with a depth -> the rows of a crawl, a page each: addresses resolved and normalised, without their fragments."""
    own = U.normalise(F.col("url"))
    named = lambda n: F.array_join(F.transform(F.filter("metas", lambda m: m["name"] == n), lambda m: m["content"]), ",")
    header = F.coalesce(F.try_element_at(F.col("headers"), F.lit("x-robots-tag")), F.lit(""))
    canonical = F.try_element_at(F.filter("canonicals", lambda c: c != ""), F.lit(1))
    here = lambda h: U.normalise(U.join(F.col("url"), h))
    return facts.select(
        own.alias("url"), "status", "depth", "ok", F.coalesce("media_type", F.lit("")).alias("media_type"), F.trim(F.try_element_at("titles", F.lit(1))).alias("title"), F.trim(F.try_element_at("descriptions", F.lit(1))).alias("description"),
        F.when(canonical.isNotNull(), here(canonical)).alias("canonical"), F.concat_ws(",", named("robots"), F.nullif(header, F.lit(""))).alias("robots"), F.when(F.col("body_text") != "", F.sha2(F.col("body_text").cast("binary"), 256)).alias("body_hash"),
        F.size(T.words(F.col("body_text"))).alias("words"), F.transform("hops", lambda h: h["url"]).alias("redirect_chain"),
        F.transform(F.filter("hreflangs", lambda h: h["href"] != ""), lambda h: F.struct(h["lang"].alias("lang"), here(h["href"]).alias("url"))).alias("hreflangs"),
    )


def link_edges(facts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, nofollow, inbound): a page's internal targets once each; nofollow if one of its links to it says so.

    Pages at max_depth were not followed any further, so their links do not count as `inbound`.
    """
    own = U.normalise(F.col("url"))
    counts = F.lit(True) if max_depth is None else F.col("depth") < max_depth
    links = facts.where("ok").select(own.alias("src"), counts.alias("inbound"), F.explode("page_links").alias("x")).where("x.internal")
    return links.groupBy("src", U.normalise(F.col("x.url")).alias("dst"), "inbound").agg(F.bool_or("x.nofollow").alias("nofollow"))


#: Codes of a crawl with their severities.
CROSSPAGE = {
    "site.duplicate_title": "high", "site.duplicate_description": "low", "site.duplicate_content": "high", "site.orphan_pages": "high", "site.too_deep": "low", "site.redirect_chains": "high", "site.redirect_loops": "critical",
    "site.canonical_to_error": "critical", "site.canonical_to_redirect": "high", "site.canonical_to_noncanonical": "high", "site.canonical_to_nonindexable": "critical", "site.nofollow_to_indexable": "high", "site.mixed_follow_signals": "low",
    "site.hreflang_no_return_link": "high", "site.hreflang_to_error": "high", "site.hreflang_to_nonindexable": "high", "site.broken_internal_links": "critical",
}


def crosspage_findings(pages: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """(code, severity, n): all cross-page codes with the number of cases; one 'site.crosspage_clean' row if there are none.

    Each row of the crawl is read three times: for what it says of itself and shares with others, for what its
    targets say, and for who links to it. Duplicates count values, alternates count pairs, all else pages. The pages' addresses are
    distinct; edges may have an `inbound` column, without which all count.
    """
    pages = cut(pages)
    fine = indexable(pages)
    url, chain = F.col("url"), F.size("redirect_chain")
    one = lambda when, code: F.when(when, F.lit(code))
    lost = ((F.col("status") >= 400) | (F.col("status") == 0)) & ~F.col("ok") & ~((F.coalesce("media_type", F.lit("")) == "") & (F.coalesce("status", F.lit(0)) == 0))
    own = F.array_compact(F.array(one(fine & (F.col("depth") > MAX_DEPTH), "site.too_deep"), one(chain > 2, "site.redirect_chains"), one(F.size(F.array_distinct("redirect_chain")) != chain, "site.redirect_loops"), one(lost, "site.broken_internal_links")))
    shared = F.when(fine, F.array(*(F.struct(F.lit(f"site.duplicate_{k}").alias("code"), F.trim(F.coalesce(c, F.lit(""))).alias("value")) for k, c in (("title", "title"), ("description", "description"), ("content", "body_hash"))))).otherwise(F.array())
    says = F.concat(F.transform(own, lambda c: F.struct(c.alias("code"), F.lit(None).cast("string").alias("value"))), F.filter(shared, lambda x: x["value"] != ""))
    said = pages.select(F.inline(says)).groupBy("code", "value").agg(F.count("*").alias("n"))
    first = said.groupBy("code").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise((F.col("n") > 1).cast("long"))).alias("n"))
    # what the targets of canonicals and alternates say
    points = F.concat(
        F.when(F.coalesce("canonical", F.lit("")).isin("") | (F.col("canonical") == url), F.array()).otherwise(F.array(F.struct(F.lit("canonical").alias("kind"), F.col("canonical").alias("dst")))),
        F.transform("hreflangs", lambda h: F.struct(F.lit("alternate").alias("kind"), h["url"].alias("dst"))),
    )
    noindex = F.contains(F.lower(F.coalesce("robots", F.lit(""))), F.lit("noindex"))
    goals = pages.select(url.alias("dst"), F.col("ok").alias("t_ok"), (chain > 1).alias("t_moved"), (F.coalesce("canonical", F.lit("")) != "").alias("t_named"), (F.col("canonical") != url).alias("t_other"), noindex.alias("t_noindex"))
    met = pages.select(url.alias("src"), F.inline(points)).join(goals, "dst")
    conflict = F.when(~F.col("t_ok"), "error").when(F.col("t_moved"), "redirect").when(F.col("t_named") & F.col("t_other"), "noncanonical").when(F.col("t_noindex"), "nonindexable")
    named = F.when(F.col("kind") == "canonical", F.concat(F.lit("site.canonical_to_"), conflict)).when(~F.col("t_ok"), "site.hreflang_to_error").when(F.col("t_noindex"), "site.hreflang_to_nonindexable")
    second = met.select(named.alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))
    # a pair of pages meets itself the other way round in one group; what is named once only has no return
    pairs = met.where("kind = 'alternate'").groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(
        F.count_if((F.col("src") <= F.col("dst")) & F.col("t_ok")).alias("there"), F.count_if((F.col("src") > F.col("dst")) & F.col("t_ok")).alias("back"), F.count_if(F.col("src") <= F.col("dst")).alias("any_there"), F.count_if(F.col("src") > F.col("dst")).alias("any_back"))
    alone = F.when(F.col("x") == F.col("y"), 0).otherwise(F.when(F.col("any_back") == 0, F.col("there")).otherwise(0) + F.when(F.col("any_there") == 0, F.col("back")).otherwise(0))
    third = pairs.select(F.lit("site.hreflang_no_return_link").alias("code"), alone.cast("long").alias("n")).groupBy("code").agg(F.sum("n").alias("n"))
    # who links to a page
    counted = F.bool_or("inbound") if "inbound" in edges.columns else F.lit(True)
    into = edges.groupBy("dst").agg(F.bool_and("nofollow").alias("only"), F.bool_or("nofollow").alias("some"), counted.alias("linked"))
    both = pages.select(url.alias("dst"), F.lit(True).alias("crawled"), (F.col("ok") & ~noindex).alias("open"), (fine & (url != start)).alias("owed")).join(into, "dst", "full_outer")
    links = F.array_compact(F.array(one(F.col("owed") & ~F.coalesce("linked", F.lit(False)), "site.orphan_pages"), one(F.col("only") & F.col("open"), "site.nofollow_to_indexable"), one(F.col("some") & ~F.col("only"), "site.mixed_follow_signals")))
    fourth = both.select(F.explode(links).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    found = first.unionAll(second).unionAll(third).unionAll(fourth).where("n > 0")
    severity = F.try_element_at(F.create_map(*(F.lit(x) for k, v in CROSSPAGE.items() for x in (k, v))), F.col("code"))
    found = cut(found.select("code", severity.alias("severity"), F.col("n").cast("long").alias("n")))  # a row a code
    clean = found.agg(F.count("*").alias("k")).where("k = 0").select(F.lit("site.crosspage_clean").alias("code"), F.lit("info").alias("severity"), F.lit(0).cast("long").alias("n"))
    return found.unionAll(clean)


def graph_edges(links: DataFrame) -> DataFrame:
    return links.where("src <> dst").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, inbound, outbound), distinct neighbours."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src"), F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").cast("long").alias("inbound"), F.sum("o").cast("long").alias("outbound"))


def exact_ranks(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(node, score), not rounded: synchronous rounds from a uniform start; the rank of dead ends is spread over all nodes.

    Edges lie by source and nodes by name once and for all, so a round shuffles only what the edges
    pass on, summed up in each task first. Ranks are cut every other round, as a round reads them twice.
    """
    edges = cut(graph_edges(edges).repartition("src"))
    nodes = cut(degrees(edges).select("node", "outbound").repartition("node"))
    n = nodes.count()
    ranks = nodes.select("node", "outbound", F.lit(1.0 / max(1, n)).alias("score"))
    for i in range(rounds):
        gets = edges.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("score") / F.col("outbound")).alias("got"))
        loose = ranks.where("outbound = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        base = F.lit((1 - damping) / max(1, n)) + F.lit(damping) * F.col("loose") / n
        ranks = nodes.join(gets, F.col("node") == F.col("to"), "left").crossJoin(F.broadcast(loose)).select("node", "outbound", (base + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score"))  # one row
        if i % 2:
            ranks = cut(ranks)
    return ranks.select("node", "score")


def pagerank(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """exact_ranks() to five places, as they are shown."""
    return exact_ranks(edges, rounds, damping).withColumn("score", F.round("score", 5))


def ranked(links: DataFrame) -> DataFrame:
    """(node, inbound, outbound, score): degrees and rank of every node."""
    return degrees(graph_edges(links)).join(pagerank(links), "node")


def ranked_exactly(links: DataFrame) -> DataFrame:
    """ranked() with ranks that are not rounded: those of many nodes are all below what five places show."""
    return degrees(graph_edges(links)).join(exact_ranks(links), "node")


def most_linked(links: DataFrame, most: int = RANKED) -> DataFrame:
    return ranked(links).orderBy(F.desc("score"), "node").limit(most)


def least_linked(links: DataFrame, most: int = RANKED) -> DataFrame:
    """The first by rank of the nodes that nothing links to."""
    return ranked(links).where("inbound = 0").orderBy(F.desc("score"), "node").limit(most)


def dead_ends(links: DataFrame, most: int = RANKED) -> DataFrame:
    """The first by rank of the nodes that link to nothing."""
    return ranked(links).where("outbound = 0").orderBy(F.desc("score"), "node").limit(most)


def bfs(edges: DataFrame, start: int, most: int, refused: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """(node, depth) by levels from start; a node is visited once, at its least depth.

    refused(node) are left out, as robots files ask for. With a budget no more nodes than that are
    visited; of the level that exceeds it the first by name are.
    """
    seen = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("depth"))
    front, left = seen, None if budget is None else budget - 1
    for d in range(1, most + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        if refused is not None:
            front = front.join(refused.select("node"), "node", "left_anti")
        if left is not None:
            front = front.orderBy("node").limit(left)
        front = cut(front.withColumn("depth", F.lit(d)))
        n = front.count()
        if not n:
            break
        seen = seen.unionAll(front)
        left = None if left is None else left - n
    return seen


def followers(events: DataFrame, key: str, order: list[str], within: Column) -> DataFrame:
    """(src, dst): the key of each event and of the next one in order, if `within` is the same for both.

    Events are sorted by ranges, so no task holds a whole day; the first event of each range, a row a
    range, is handed to the one before it.
    """
    rows = events.select(key, *order, within.alias("within_")).repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    rows = cut(rows)
    firsts = rows.groupBy("part_").agg(F.min(F.struct(*order, "within_", key)).alias("first_"))
    w = Window.orderBy("part_")  # a row a range
    after = firsts.select("part_", F.lead("first_").over(w).alias("next_"))
    own = Window.partitionBy("part_").orderBy(*order)
    nxt = F.lead(F.struct(*order, "within_", key)).over(own)
    rows = rows.withColumn("near_", nxt).join(F.broadcast(after), "part_")  # a row a range
    nxt = F.coalesce("near_", "next_")
    return rows.where(nxt["within_"] == F.col("within_")).select(F.col(key).alias("src"), nxt[key].alias("dst"))


def robots_rules(files: DataFrame) -> DataFrame:
    """files(site, body) -> (site, agent, group_ord, ord, kind, pattern). A run of user-agent lines shares the rules below it."""
    lines = files.select("site", F.posexplode(F.split("body", r"\r?\n", -1)).alias("ord", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("site", "ord", bare.alias("line")).where(F.contains("line", F.lit(":")))
    lines = lines.select("site", "ord", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("site").orderBy("ord")
    new = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("block", F.sum(new.cast("int")).over(w))
    agents = lines.where("field = 'user-agent'").select("site", "block", F.lower("value").alias("agent"), F.col("ord").alias("group_ord"))
    rules = lines.where("field <> 'user-agent'").select("site", "block", "ord", F.col("field").alias("kind"), F.col("value").alias("pattern"))
    return agents.join(rules, ["site", "block"], "left").select("site", "agent", "group_ord", "ord", "kind", "pattern")


def agent_rules(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(site, agent) -> (site, agent, patterns), a row for each distinct pair: the rules that hold for an agent on a site, longest first.

    An agent takes the first group whose name contains it or is contained in it, else *; all rules of that name count,
    wherever they stand in the file. A site without rules for it has an empty list. A file's rules are few, whatever
    the number of its pages, so an agent's are one list.
    """
    p = F.col("pattern")
    quoted = F.regexp_replace(p, r"([\\^.|?+()\[\]{}])", r"\\$1")
    rx = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\$(?=.)", r"\\\$"), r"\*", ".*"))
    plain = ~F.contains(p, F.lit("*")) & ~F.contains(p, F.lit("$"))
    rule = F.when(F.coalesce(p, F.lit("")) != "", F.struct(F.length(p).alias("n"), (F.col("kind") == "allow").alias("allow"), p.alias("start"), F.when(~plain, rx).alias("rx")))
    sets = rules.groupBy("site", F.col("agent").alias("name")).agg(F.min("group_ord").alias("first"), F.reverse(F.array_sort(F.collect_set(rule))).alias("patterns"))
    low = F.lower("agent")
    named = (F.col("name") != "") & (F.col("name") != "*") & (F.contains(low, F.col("name")) | F.contains(F.col("name"), low))
    rank = F.when(named, F.struct(F.lit(0), F.col("first"), F.col("name"))).when(F.col("name") == "*", F.struct(F.lit(1), F.col("first"), F.col("name")))
    j = asked.select("site", "agent").distinct().join(sets, "site", "left")
    best = j.groupBy("site", "agent").agg(F.min_by("patterns", rank).alias("patterns"))
    return best.select("site", "agent", F.coalesce("patterns", F.array()).cast("array<struct<n:int,allow:boolean,start:string,rx:string>>").alias("patterns"))


def path_allowed(patterns: Column, path: Column) -> Column:
    """The verdict of an agent's rules on a path: the longest that matches wins, allow on ties; without one all is allowed."""
    met = F.filter(patterns, lambda x: F.when(x["rx"].isNull(), F.startswith(path, x["start"])).otherwise(F.regexp_like(path, x["rx"])))
    return F.coalesce(F.try_element_at(met, F.lit(1))["allow"], F.lit(True))


def robots_verdict(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(site, agent, path) -> (site, agent, path, allowed), a row for each row. The longest matching rule wins, allow on ties.

    The group is chosen once for a site and agent; a path meets one row with that group's rules, so a site of many pages is
    not multiplied by its rules.
    """
    own = agent_rules(rules, asked)
    j = asked.select("site", "agent", "path").join(own, ["site", "agent"], "left")
    return j.select("site", "agent", "path", path_allowed(F.col("patterns"), F.col("path")).alias("allowed"))


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """docs(site, url, body) -> (site, kind, loc): XML urlsets and indexes, or plain text with a URL a line."""
    body = F.coalesce("body", F.lit(""))
    kind = F.when(body.rlike("(?i)<sitemapindex"), "index").when(body.rlike("(?i)<urlset"), "urlset").when(body.rlike(r"(?m)^\s*https?://"), "text").otherwise("unknown")
    xml = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    text = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike("^https?://"))
    found = F.filter(F.when(kind == "text", text).otherwise(xml), lambda x: x != "")
    return docs.select("site", kind.alias("kind"), F.explode_outer(found).alias("loc"))


def follow_index(entries: DataFrame, files: DataFrame, most: int = 1000) -> DataFrame:
    """entries(site, kind, loc) with the entries of the maps that an index lists (one level, `most` maps of a site at most) in place of the index.

    files(site, url, body) are the captured maps; (site, kind, loc). A listed map that was not captured gives kind 'missing'.
    """
    w = Window.partitionBy("site").orderBy("loc")
    children = entries.where("kind = 'index'").select("site", "loc").distinct().withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= most).drop("place_")
    known = sitemap_entries(files.join(children.select("site", F.col("loc").alias("url")), ["site", "url"], "left_semi"))
    lost = children.join(files.select("site", F.col("url").alias("loc")), ["site", "loc"], "left_anti")
    return entries.where("kind <> 'index'").unionAll(known.where("kind <> 'index'")).unionAll(lost.select("site", F.lit("missing").alias("kind"), "loc"))


def sitemap_diff(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, verdict): in one of sitemap and crawl only, or in both and broken or noindex, or ok."""
    e = entries.where(F.col("loc").isNotNull()).select(F.col("loc").alias("url")).distinct().withColumn("listed", F.lit(True))
    p = pages.select("url", "status", indexable(pages).alias("fine"), F.lit(True).alias("crawled"))
    j = e.join(p, "url", "full_outer")
    v = F.when(F.col("crawled").isNull(), "not_crawled").when(F.col("listed").isNull(), F.when(F.col("fine"), "not_listed")).when(F.col("status") >= 400, "broken").when(~F.col("fine"), "noindex").otherwise("ok")
    return j.select("url", v.alias("verdict")).where("verdict IS NOT NULL")
