"""The page checks: each is a column of findings over the facts of a page; nothing here shuffles.

A finding is struct(code, severity). A check holds for HTML pages that were fetched with status 200
unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import urls as U
from pagelake.functions.constants import AUTHORITIES, CALLS, FILLER, HEDGES, INJECTIONS, PAGE_TYPES, SCHEMA_RULES, SEVERITIES
from pagelake.functions.facts import with_facts

CHECKS: dict[str, tuple[Callable[[], Column], Callable[[], Column] | None]] = {}
_FINDING = "array<struct<code:string,severity:string>>"


def html_200() -> Column:
    return F.col("ok") & (F.col("media_type") == "text/html") & F.col("error").isNull()


def register(prefix: str, applies: Callable[[], Column] | None = html_200) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Adds a check; a second one of the same prefix is an error."""

    def add(f: Callable[[], Column]) -> Callable[[], Column]:
        if prefix in CHECKS:
            raise ValueError(f"there is a check {prefix!r} already")
        CHECKS[prefix] = (f, applies)
        return f

    return add


def _f(when: Column, code: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def _list(*findings: Column) -> Column:
    return F.array_compact(F.array(*findings)).cast(_FINDING)


def _first(*findings: Column) -> Column:
    return _list(F.coalesce(*findings))


def _n(col: str) -> Column:
    return F.size(F.col(col))


def _prose_words() -> Column:
    return F.col("n_words")


@register("status", None)
def status() -> Column:
    s, hops = F.col("status"), F.coalesce(_n("hops"), F.lit(0))
    gone = F.col("blocked_reason").isNotNull() | (F.col("error").isNotNull() & (F.coalesce(s, F.lit(0)) == 0))
    urls = F.transform("hops", lambda h: h["url"])
    rest = _list(
        _f((s >= 300) & (s < 400), "status.3xx", "high"), _f((s >= 400) & (s < 500), "status.4xx", "critical"), _f(s >= 500, "status.5xx", "critical"),
        _f(hops > 2, "redirect.chain", "high"), _f(F.size(F.array_distinct(urls)) < hops, "redirect.loop", "critical"),
        _f(F.col("ttfb_ms") > 800, "ttfb.slow", "low"), _f(U.scheme(F.coalesce(F.try_element_at(urls, F.lit(1)), F.col("url"))) == "http", "scheme.http", "high"),
    )
    return F.when(gone, _first(_f(F.col("blocked_reason").isNotNull(), "fetch.blocked", "critical"), _f(F.lit(True), "fetch.failed", "critical"))).otherwise(rest)


@register("title")
def title() -> Column:
    n = F.coalesce(F.length(F.try_element_at(F.col("titles"), F.lit(1))), F.lit(0))
    return _list(_f(n == 0, "title.empty", "critical"), _f(n.between(1, 19), "title.short", "low"), _f(n > 60, "title.long", "low"), _f(_n("titles") > 1, "title.multiple", "high"))


@register("description")
def description() -> Column:
    n = F.coalesce(F.length(F.try_element_at(F.col("descriptions"), F.lit(1))), F.lit(0))
    return _list(_f(n == 0, "description.empty", "high"), _f(n.between(1, 79), "description.short", "low"), _f(n > 160, "description.long", "low"), _f(_n("descriptions") > 1, "description.multiple", "high"))


@register("headings")
def headings() -> Column:
    levels = F.transform("headings", lambda h: h["level"])
    top = F.filter("headings", lambda h: h["level"] == 1)
    told = F.exists(top, lambda h: h["text"] != "")
    skips = F.exists(F.arrays_zip(levels.alias("a"), F.slice(levels, F.lit(2), F.size(levels)).alias("b")), lambda x: F.coalesce(x["b"] > x["a"] + 1, F.lit(False)))
    return _list(_f(~told, "h1.missing", "high"), _f(told & (F.size(top) > 1), "h1.multiple", "low"), _f(skips, "headings.order", "low"))


@register("canonical")
def canonical() -> Column:
    own = F.try_element_at(F.col("canonicals"), F.lit(1))
    header = F.trim(F.regexp_extract(F.coalesce(F.try_element_at(F.col("headers"), F.lit("link")), F.lit("")), r'(?i)<([^>]+)>\s*;\s*rel\s*=\s*"?canonical"?', 1))
    href = F.coalesce(own, header)
    place = lambda h: F.rtrim(U.join(F.col("url"), h), F.lit("/"))
    return F.when(own.isNull() & (header == ""), _list(_f(F.lit(True), "canonical.missing", "low"))).otherwise(
        _list(
            _f(_n("canonicals") > 1, "canonical.multiple", "high"), _f((href != "") & ~href.rlike("^https?://"), "canonical.relative", "high"),
            _f((header != "") & (place(header) != place(own)), "canonical.mismatch", "high"),
            _f(place(href) != F.rtrim(F.col("url"), F.lit("/")), "canonical.other", "info"),
        )
    )


@register("indexability")
def indexability() -> Column:
    tags = F.flatten(F.transform(F.filter("metas", lambda m: m["name"].isin("robots", "googlebot")), lambda m: F.split(m["content"], ",")))
    header = F.split(F.coalesce(F.try_element_at(F.col("headers"), F.lit("x-robots-tag")), F.lit("")), ",")
    all_ = F.transform(F.concat(tags, header), lambda x: F.lower(F.trim(x)))
    has = lambda x: F.array_contains(all_, x)
    return _list(
        _f(has("noindex"), "robots.noindex", "critical"), _f(has("nofollow"), "robots.nofollow", "high"),
        _f(has("nosnippet"), "robots.nosnippet", "low"), _f(has("noimageindex"), "robots.noimageindex", "low"),
    )


@register("language")
def language() -> Column:
    lang = F.coalesce("lang", F.lit(""))
    return _list(_f(lang == "", "lang.missing", "low"), _f((lang != "") & ~lang.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), "lang.invalid", "low"))


@register("viewport")
def viewport() -> Column:
    return _list(_f(~F.exists("metas", lambda m: (m["name"] == "viewport") & (m["content"] != "")), "viewport.missing", "high"))


@register("content")
def content() -> Column:
    n = F.col("content_words")
    return _list(_f(n < 50, "content.thin", "high"), _f((n >= 50) & (n < 200), "content.thin", "low"), _f(F.col("elements") > 1500, "dom.large", "low"))


@register("metaplace")
def metaplace() -> Column:
    stray = F.exists("metas", lambda m: m["body"] & m["name"].isin("description", "robots", "keywords", "viewport"))
    return _list(_f(stray, "meta.in_body", "high"))


@register("url", lambda: (F.col("media_type") == "text/html") & F.col("error").isNull())
def url() -> Column:
    return F.transform(U.shape(F.col("url")), lambda c: F.struct(c.alias("code"), F.lit("low").alias("severity"))).cast(_FINDING)


@register("security")
def security() -> Column:
    lacks = lambda h: ~F.coalesce(F.map_contains_key("headers", h), F.lit(False))
    return _list(
        _f((U.scheme(F.col("url")) == "https") & lacks("strict-transport-security"), "header.hsts_missing", "low"),
        _f(lacks("content-security-policy"), "header.csp_missing", "low"), _f(F.lower(F.coalesce(F.try_element_at(F.col("headers"), F.lit("x-content-type-options")), F.lit(""))) != "nosniff", "header.nosniff_missing", "low"),
    )


@register("forms")
def forms() -> Column:
    finding = lambda code: F.struct(F.lit(code).alias("code"), F.lit("critical").alias("severity"))
    found = F.transform("forms", lambda a: F.when(U.scheme(U.join(F.col("url"), a)) == "http", finding("form.insecure_action")).when(U.scheme(F.col("url")) != "https", finding("form.on_http")))
    return F.array_compact(found).cast(_FINDING)


@register("asai", lambda: html_200() & F.col("rendered_text").isNotNull())
def asai() -> Column:
    raw, full = T.word_count(F.col("visible_text")), T.word_count(F.col("rendered_text"))
    a = T.shingles(F.col("visible_text"))
    share = T.bind(T.shingles(F.col("rendered_text")), lambda r: F.size(F.array_except(r, a)) / F.greatest(F.size(r), F.lit(1)))
    return _first(
        _f((raw < 20) & (full < 20), "asai.empty", "high"), _f((raw < 50) & (full >= 200), "asai.js_required", "critical"), _f(share >= 0.5, "asai.mostly_js", "critical"),
        _f(share >= 0.2, "asai.partly_js", "high"), _f(share > 0.02, "asai.some_js", "low"), _f(F.lit(True), "asai.server_rendered", "info"),
    )


#: Schemes that are no places to go to.
_NO_PLACE = "(?i)^(#|mailto:|tel:|javascript:|data:|sms:|ftp:|about:|blob:)"


def resolved_links() -> Column:
    """array<struct(href, url, text, rel, image, internal, nofollow)> of the links that lead to http(s) places."""
    base = F.when(F.col("base_href").isNull(), F.col("url")).otherwise(U.join(F.col("url"), F.col("base_href")))
    own = U.registrable(U.host(base))
    kept = F.filter("links", lambda x: (x["href"] != "") & ~x["href"].rlike(_NO_PLACE))
    out = F.transform(kept, lambda x: F.struct(x["href"].alias("href"), U.join(base, x["href"]).alias("url"), x["text"].alias("text"), x["rel"].alias("rel"), x["image"].alias("image")))
    out = F.filter(out, lambda x: x["url"].rlike("(?i)^https?:"))
    return F.transform(out, lambda x: F.struct(x["href"], x["url"], x["text"], x["rel"], x["image"], (U.registrable(U.host(x["url"])) == own).alias("internal"), F.contains(x["rel"], F.lit("nofollow")).alias("nofollow")))


def page_nofollow() -> Column:
    meta = F.exists("metas", lambda m: m["name"].isin("robots", "googlebot") & F.contains(F.lower(m["content"]), F.lit("nofollow")))
    return meta | F.contains(F.lower(F.coalesce(F.try_element_at(F.col("headers"), F.lit("x-robots-tag")), F.lit(""))), F.lit("nofollow"))


_LOCAL = ("localhost", "127.0.0.1", "0.0.0.0", "::1")


@register("links")
def links() -> Column:
    all_ = F.col("page_links")
    some = lambda f: F.exists(all_, f)
    off = page_nofollow()
    inside = some(lambda x: x["internal"])
    return _list(
        _f(F.size(all_) == 0, "links.deadend", "high"), _f(F.size(all_) > 100, "links.too_many", "low"),
        F.when(off & inside, F.struct(F.lit("links.internal_nofollow").alias("code"), F.lit("high").alias("severity"))).otherwise(_f(some(lambda x: x["internal"] & x["nofollow"]), "links.internal_nofollow", "low")),
        _f(~off & some(lambda x: ~x["internal"] & ~x["nofollow"]), "links.external_dofollow", "info"),
        _f((U.scheme(F.col("url")) == "https") & some(lambda x: F.lower(x["url"]).startswith("http://")), "links.http_on_https", "high"),
        _f(~U.host(F.col("url")).isin("localhost", "127.0.0.1") & some(lambda x: U.host(x["url"]).isin(*_LOCAL)), "links.localhost", "high"),
        _f(some(lambda x: (x["text"] == "") & ~x["image"]), "links.empty_anchor", "low"),
    )


@register("images")
def images() -> Column:
    some = lambda f: F.exists("images", f)
    no_size = lambda i: F.coalesce(i["width"], F.lit("")).isin("") | F.coalesce(i["height"], F.lit("")).isin("")
    told = F.concat_ws(" ", F.transform(F.filter("metas", lambda m: m["name"].isin("robots", "googlebot")), lambda m: m["content"]), F.try_element_at(F.col("headers"), F.lit("x-robots-tag")))
    robots = F.contains(F.lower(told), F.lit("noimageindex"))
    return _list(
        _f(F.col("bare_pictures") > 0, "images.picture_without_img", "high"), _f(some(lambda i: i["alt"].isNull()), "images.no_alt", "high"),
        _f(some(lambda i: F.length(F.trim(i["alt"])) > 100), "images.long_alt", "low"), _f(some(no_size), "images.no_dimensions", "low"),
        _f(robots & (_n("images") > 0), "images.noimageindex", "high"), _f(some(lambda i: F.lower(F.regexp_replace(i["src"], r"[?#].*$", "")).rlike(r"\.(bmp|tiff?)$")), "images.legacy_format", "low"),
        _f(F.try_element_at(F.col("images"), F.lit(1))["loading"] == "lazy", "images.lazy_first", "low"),
    )


_BCP47 = "(?i)^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?$"


def same_url(a: Column, b: Column) -> Column:
    """Equality of alternates: scheme and host in any case, port and last slash aside, query kept."""
    key = lambda u: F.concat(U.scheme(u), F.lit("://"), U.host(u), F.rtrim(U.path(u), F.lit("/")), U.query(u))
    return key(a) == key(b)


def alternates() -> Column:
    """array<struct(lang, href)> of the HTML and of the Link header."""
    header = F.coalesce(F.try_element_at(F.col("headers"), F.lit("link")), F.lit(""))
    rx = r"""(?i)<([^>]+)>\s*;\s*rel\s*=\s*"?alternate"?[^,]*?hreflang\s*=\s*"?([^";,]+)"?"""
    of = lambda k: F.transform(F.regexp_extract_all(header, F.lit(rx), F.lit(k)), lambda x: F.trim(x))
    return F.concat("hreflangs", F.transform(F.arrays_zip(of(2).alias("lang"), of(1).alias("href")), lambda x: F.struct(x["lang"].alias("lang"), x["href"].alias("href"))))


@register("hreflang", lambda: html_200() & (F.size(alternates()) > 0))
def hreflang() -> Column:
    tags = alternates()
    low = F.transform(tags, lambda t: F.lower(t["lang"]))
    some = lambda f: F.exists(tags, f)
    is_self = lambda t: (t["href"] != "") & same_url(U.join(F.col("url"), t["href"]), F.col("url"))
    html_lang = F.lower(F.coalesce("lang", F.lit("")))
    clash = some(lambda t: is_self(t) & (F.lower(t["lang"]) != "x-default") & (F.lower(t["lang"]) != html_lang))
    found = _list(
        _f(~F.array_contains(low, "x-default"), "hreflang.no_xdefault", "low"), _f(~some(is_self), "hreflang.no_self_reference", "high"),
        _f((html_lang != "") & clash, "hreflang.lang_mismatch", "high"),
        _f(some(lambda t: (t["href"] != "") & ~t["href"].rlike("^[A-Za-z][A-Za-z0-9+.-]*:")), "hreflang.relative_url", "high"),
        _f(some(lambda t: (F.lower(t["lang"]) != "x-default") & ~t["lang"].rlike(_BCP47)), "hreflang.malformed_code", "high"), _f(F.size(F.array_distinct(low)) < F.size(low), "hreflang.duplicate_code", "high"),
        _f(some(lambda t: t["href"] == ""), "hreflang.missing_href", "high"),
    )
    return F.when(F.size(found) == 0, _list(_f(F.lit(True), "hreflang.ok", "info"))).otherwise(found)


@register("schema")
def schema() -> Column:
    finding = lambda code, sev: F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))
    invalid = F.transform(F.sequence(F.lit(1), F.greatest(F.col("bad_blocks"), F.lit(1))), lambda _: finding("schema.invalid_json", "high"))
    per_block = F.when(F.col("bad_blocks") > 0, invalid).otherwise(F.array()).cast(_FINDING)
    rules = F.create_map(*(x for t, (need, want) in SCHEMA_RULES.items() for x in (F.lit(t), F.struct(F.array(*map(F.lit, need)).cast("array<string>").alias("need"), F.array(*map(F.lit, want)).cast("array<string>").alias("want")))))

    def lacks(key: str, code: str, sev: str) -> Column:
        """A finding for each node and type of which a property is missing."""
        each = F.transform("nodes", lambda n: F.transform(F.filter(n["types"], lambda t: F.size(F.array_except(F.try_element_at(rules, t)[key], n["props"])) > 0), lambda _: finding(code, sev)))
        return F.flatten(each).cast(_FINDING)

    title = F.coalesce(F.try_element_at(F.col("titles"), F.lit(1)), F.lit(""))
    names = F.filter(F.transform(F.filter("nodes", lambda n: F.arrays_overlap(n["types"], F.array(*map(F.lit, PAGE_TYPES)))), lambda n: n["name"]), lambda x: F.length(x) > 10)
    contradicts = (title != "") & (F.size(names) > 0) & ~F.exists(names, lambda x: T.agrees(x, title))
    none = _first(_f(F.col("legacy"), "schema.legacy_only", "low"), _f(F.lit(True), "schema.missing", "high"))
    rest = F.concat(
        per_block, _list(_f((_n("nodes") > 0) & ~F.exists("nodes", lambda n: n["context"]), "schema.no_context", "high")),
        lacks("need", "schema.missing_required", "high"), lacks("want", "schema.missing_recommended", "low"), _list(_f(contradicts, "schema.contradicts_page", "high")),
    )
    done = T.bind(rest, lambda x: F.when(F.exists(x, lambda f: f["severity"] == "high"), x).otherwise(F.concat(x, _list(_f(F.lit(True), "schema.present", "info")))))
    return F.when((_n("nodes") == 0) & (F.col("bad_blocks") == 0), none).otherwise(done)


@register("social")
def social() -> Column:
    og = F.filter("metas", lambda m: m["property"].startswith("og:"))
    card = F.exists("metas", lambda m: (m["name"] == "twitter:card") & (m["content"] != ""))
    any_card = F.exists("metas", lambda m: m["name"].startswith("twitter:"))
    lacking = F.size(F.filter(F.array(*map(F.lit, ("og:title", "og:description", "og:image"))), lambda k: ~F.exists(og, lambda m: (m["property"] == k) & (m["content"] != ""))))
    found = _list(
        _f(lacking == 3, "social.no_opengraph", "low"), _f(lacking.between(1, 2), "social.incomplete_opengraph", "low"), _f((F.size(og) > 0) & ~card, "social.no_twitter_card", "low"),
    )
    return F.when((F.size(found) == 0) & ((F.size(og) > 0) | any_card), _list(_f(F.lit(True), "social.ok", "info"))).otherwise(found)


def lead() -> Column:
    """The first paragraph or list item of at least twelve words, or null."""
    return F.try_element_at(F.filter("paragraphs", lambda p: F.size(T.words(p)) >= 12), F.lit(1))


@register("aeo", lambda: html_200() & (_prose_words() >= 50))
def aeo() -> Column:
    heading = F.coalesce(F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"], F.lit(""))
    asks = heading.endswith("?") | heading.rlike("(?i)^(how|what|why|when|where|who|is|are|can|should|does|do) ")
    n = T.word_count(lead())
    w = T.words(F.col("body_text"))
    cut = F.greatest(F.lit(1), F.floor(F.size(w) * 3 / 10).cast("int"))
    head = F.size(T.statistics(F.array_join(F.slice(w, 1, cut), " ")))
    tail = F.size(T.statistics(F.array_join(F.slice(w, cut + 1, 1000000000), " ")))
    return _list(
        F.coalesce(_f(lead().isNull(), "aeo.no_lead", "high"), _f(asks & (n > 80), "aeo.answer_buried", "high"), _f(n > 120, "aeo.long_lead", "low")),
        _f((tail >= 3) & (head == 0), "aeo.not_front_loaded", "low"),
    )


@register("evidence", lambda: html_200() & (_prose_words() >= 100))
def evidence() -> Column:
    n = F.col("n_statistics")
    source = F.exists("links", lambda x: x["href"].rlike("(?i)^https?://") & T.any_phrase(x["href"], AUTHORITIES))
    return _list(
        _f(n == 0, "evidence.no_statistics", "high"), _f((n > 0) & (n / (_prose_words() / 100) < 0.5), "evidence.few_statistics", "low"),
        _f(~source, "evidence.no_sources", "low"), _f(source, "evidence.sources_present", "info"), _f(F.col("quotes") > 0, "evidence.quotes_present", "info"),
    )


@register("chunk", lambda: html_200() & (_prose_words() >= 150))
def chunk() -> Column:
    subs = F.size(F.filter("headings", lambda h: h["level"].between(2, 4)))
    parts = (F.col("lists") > 0) | (F.col("tables") > 0)
    return _list(
        _f(subs == 0, "chunk.no_sections", "high"), _f((subs > 0) & (_prose_words() / (subs + 1) > 500), "chunk.sections_too_long", "low"),
        _f(~parts, "chunk.no_structure", "low"), _f(parts, "chunk.structured", "info"), _f(F.col("long_paragraphs") > 0, "chunk.long_paragraphs", "low"),
    )


@register("readability", lambda: html_200() & (_prose_words() >= 120))
def readability() -> Column:
    r = F.col("reading")
    return _list(
        F.coalesce(_f(r["flesch"] < 30, "readability.very_hard", "low"), _f(r["flesch"] > 90, "readability.very_simple", "info"), _f(r["flesch"].isNotNull(), "readability.ok", "info")),
        _f(r["words_per_sentence"] > 30, "readability.long_sentences", "low"),
        _f(T.phrase_hits(F.col("body_text"), FILLER) >= 3, "readability.filler", "low"), _f(T.phrase_hits(F.col("body_text"), HEDGES) >= 4, "readability.hedging", "low"),
    )


@register("freshness")
def freshness() -> Column:
    names = ("article:published_time", "article:modified_time", "date", "last-modified", "og:updated_time", "datepublished", "datemodified")
    dated = (
        F.exists("metas", lambda m: F.when(m["property"] != "", m["property"]).otherwise(m["name"]).isin(*names)) | (_n("times") > 0) | (F.coalesce(F.try_element_at(F.col("headers"), F.lit("last-modified")), F.lit("")) != "")
        | F.exists("jsonld", lambda j: j.rlike(r'"date(Published|Modified)"\s*:\s*"[^"]{4,40}"'))
    )
    return _first(_f(dated, "freshness.dated", "info"), _f(F.lit(True), "freshness.undated", "low"))


@register("multimodal")
def multimodal() -> Column:
    told = F.col("body_text").rlike("(?i)transcript") | (F.col("tracks") > 0)
    return _list(
        _f((F.col("embeds") > 0) & ~told, "multimodal.no_transcript", "low"), _f((F.col("embeds") > 0) & told, "multimodal.transcript_present", "info"),
        _f(F.col("figures") > F.col("captions"), "multimodal.no_caption", "low"),
    )


@register("author")
def author() -> Column:
    named = (
        F.exists("metas", lambda m: m["name"].isin("author", "article:author", "twitter:creator")) | F.col("author_rel").isNotNull()
        | F.exists("jsonld", lambda j: j.rlike(r'"author"\s*:\s*(\{[^}]*"name"\s*:\s*"[^"]+"|"[^"]+")')) | F.substring("body_text", 1, 1500).rlike(rf"{T.EDGE}by\s+[A-Z][a-z]+\s+[A-Z][a-z]+")
    )
    return _first(_f(named, "author.present", "info"), _f(F.lit(True), "author.missing", "low"))


#: Characters of a page's comments that are searched for instructions.
_COMMENT_CHARS = 20_000


@register("injection")
def injection() -> Column:
    says = lambda t: T.any_phrase(t, INJECTIONS)
    commented = says(F.substring(F.array_join("comments", " "), 1, _COMMENT_CHARS))
    unseen = says(F.array_join(F.transform("hidden", lambda h: h["text"]), " "))
    most, soft = T.most_of_one_invisible(F.col("html"))
    tags = F.col("html").rlike("[\\x{E0000}-\\x{E007F}]")
    lookalikes = F.regexp_count("body_text", F.lit("[\\p{IsCyrillic}&&\\p{L}&&[\\x{2001}-\\x{10FFFF}]]"))
    found = _list(
        _f(F.exists("hidden", lambda h: h["deceptive"]), "injection.hidden_text", "high"), _f(tags | (most >= 20) | (soft >= 50), "injection.invisible_unicode", "high"),
        _f(says(F.col("body_text")), "injection.phrasing", "low"), _f(commented, "injection.instructions", "high"), _f(unseen, "injection.instructions", "high"),
        _f(lookalikes > 20, "injection.confusable_script", "low"),
    )
    return F.when(F.size(found) == 0, _list(_f(F.lit(True), "injection.clean", "info"))).otherwise(found)


# Title words that no page is about, and host labels that name no brand.
TITLE_WORDS = ("with", "from", "your", "that", "this", "have", "what", "will")
_LABELS = ("www", "com", "org", "net", "io", "dev", "app", "co", "ai", "xyz")


@register("clutter", lambda: html_200() & (_prose_words() >= 80))
def clutter() -> Column:
    n = _prose_words()
    calls = T.phrase_total(F.col("body_text"), CALLS)
    ratio = 1 - F.col("article_words") / n
    site = F.flatten(F.transform(F.filter("metas", lambda m: m["property"] == "og:site_name"), lambda m: F.regexp_extract_all(F.lower(m["content"]), F.lit("[a-z]{4,}"), F.lit(0))))
    declared = F.flatten(F.transform("jsonld", lambda j: F.regexp_extract_all(F.lower(F.array_join(F.regexp_extract_all(j, F.lit(r'"name"\s*:\s*"([^"]{2,60})"'), F.lit(1)), " ")), F.lit("[a-z]{4,}"), F.lit(0))))
    brand = F.concat(site, declared, F.filter(F.split(U.host(F.col("url")), r"\."), lambda x: ~x.isin(*_LABELS)))
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.try_element_at(F.col("titles"), F.lit(1)), F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)), lambda t: ~t.isin(*TITLE_WORDS) & ~F.array_contains(brand, t))
    tokens = F.regexp_extract_all(F.lower("body_text"), F.lit("[a-z]{4,}"), F.lit(0))
    often = lambda k: F.exists(F.array_distinct(terms), lambda t: T.bind(F.size(F.filter(k, lambda x: x == t)), lambda c: (c >= 10) & (c / n > 0.035)))
    stuffed = (n >= 200) & T.bind(tokens, often)
    return _list(
        _f((n < 400) & (calls >= 5), "clutter.cta_overload", "low"), _f((ratio > 0.6) & (F.col("article_words") < 400), "clutter.boilerplate", "low"),
        _f(stuffed, "clutter.keyword_stuffing", "high"), _f(F.col("popups") >= 3, "clutter.interstitials", "low"),
    )


def captured(pages: DataFrame) -> DataFrame:
    """Captured-response columns for pages of which only url and html are known: fetched well, no headers."""
    return pages.select(
        "page_id", "url", "html", F.lit(200).alias("status"), F.lit(True).alias("ok"), F.lit("text/html").alias("media_type"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("blocked_reason"), F.create_map().cast("map<string,string>").alias("headers"), F.array(F.struct(F.col("url").alias("url"))).alias("hops"),
        F.lit(100).alias("ttfb_ms"), F.lit(None).cast("string").alias("rendered_text"),
    )


def prepared(pages: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Captured pages with facts, resolved links and the number of figures, which several checks ask for; or with some facts only, and `page_links` among them if links are."""
    df = with_facts(pages, only=None if only is None else {*only, "base_href"} if "links" in only else only)
    if only is None or "links" in only:
        df = df.withColumn("page_links", resolved_links())
    return df if only is not None else df.withColumn("n_statistics", F.size(T.statistics(F.col("body_text"))))


def found_rows(*prefixes: str) -> Column:
    """Array of (check, found) of the named checks, or of all, over the facts of a page."""
    none = F.array().cast(_FINDING)
    parts = []
    for p in prefixes or CHECKS:
        f, applies = CHECKS[p]
        own = f() if applies is None else F.when(applies(), f()).otherwise(none)
        parts.append(F.coalesce(own, none))
    return F.array(*(F.struct(F.lit(p).alias("check"), a.alias("found")) for p, a in zip(prefixes or CHECKS, parts, strict=True)))


def findings(facts: DataFrame, *prefixes: str) -> DataFrame:
    """(page_id, check, code, severity, rank) of the named checks, or of all."""
    df = facts.select("page_id", F.explode(found_rows(*prefixes)).alias("r")).select("page_id", "r.check", F.explode("r.found").alias("x"))
    rank = F.try_element_at(F.create_map(*(F.lit(v) for s, (r, _) in SEVERITIES.items() for v in (s, r))), F.col("severity"))
    return df.select("page_id", "check", "x.code", "x.severity").withColumn("rank", rank)
