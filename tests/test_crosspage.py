"""Cross-page audit of a small crawl in which each kind of fault is there once or twice."""

from pyspark.sql import functions as F

from pagelake.operators import page_checks as C
from pagelake.operators import site as S
from .literal_site import CRAWL, EDGES

H = "https://s.test"


def found(pages, edges):
    return {(r.code, r.severity): r.n for r in S.crosspage_findings(pages, edges, H + "/").collect()}


def test_every_code(spark):
    counts = dict.fromkeys(S.CROSSPAGE, 1) | {"site.nofollow_to_indexable": 2, "site.hreflang_no_return_link": 2, "site.redirect_chains": 2}
    assert found(CRAWL.df(spark), EDGES.df(spark)) == {(k, S.CROSSPAGE[k]): n for k, n in counts.items()}


def test_single_operators_agree(spark):
    p, e = CRAWL.df(spark), EDGES.df(spark)
    all_ = {k: n for (k, _), n in found(p, e).items()}
    kinds = {r.conflict: r["count"] for r in S.canonical_conflicts(p).groupBy("conflict").count().collect()}
    assert kinds == {k: all_[f"site.canonical_to_{k}"] for k in ("error", "redirect", "noncanonical", "nonindexable")}
    assert S.hreflang_return(p).count() == all_["site.hreflang_no_return_link"] and S.orphans(p, e, H + "/").count() == 1
    assert {r.signal: r["count"] for r in S.follow_signals(p, e).groupBy("signal").count().collect()} == {"nofollow_only": 2, "mixed": 1}


def test_a_clean_crawl_and_no_crawl(spark):
    p, e = CRAWL.df(spark), EDGES.df(spark)
    assert found(p.where(f"url = '{H}/'"), e.limit(0)) == {("site.crosspage_clean", "info"): 0}
    assert found(p.limit(0), e.limit(0)) == {("site.crosspage_clean", "info"): 0}


def test_links_from_the_deepest_pages_do_not_count_as_inbound(spark):
    """What a crawl has not followed proves nothing; repeated links are one, and a nofollow among them counts."""
    html = '<html><head><title>{}</title></head><body><p>{} words of this page</p>{}</body></html>'
    a = lambda to, rel="": f'<a href="{to}" rel="{rel}">x</a>'
    rows = [(0, f"{H}/", html.format("a", "a", a("/1") + a("/1#f", "nofollow") + a("https://other.test/"))), (1, f"{H}/1", html.format("b", "b", a("2"))), (2, f"{H}/2", html.format("c", "c", a("/3"))), (3, f"{H}/3", None)]
    facts = C.prepared(C.captured(spark.createDataFrame(rows, "page_id long, url string, html string"))).withColumn("depth", F.col("page_id").cast("int"))
    edges = S.link_edges(facts, 2)
    assert sorted((r.src[len(H) :], r.dst[len(H) :], r.nofollow, r.inbound) for r in edges.collect()) == [("/", "/1", True, True), ("/1", "/2", False, True), ("/2", "/3", False, False)]
    got = found(S.crawl_pages(facts), edges)
    assert got == {("site.nofollow_to_indexable", "high"): 1, ("site.orphan_pages", "high"): 1}
    assert found(S.crawl_pages(facts), S.link_edges(facts)) == {("site.nofollow_to_indexable", "high"): 1}


def test_a_hot_target(spark):
    """Many pages that name one page as their canonical and alternate, share its title, and link to it."""
    n = 3000
    pages = spark.range(n).select(F.concat(F.lit(f"{H}/"), F.col("id").cast("string")).alias("url"), F.lit(200).alias("status"), F.lit(1).alias("depth"), F.lit(True).alias("ok"), F.lit("text/html").alias("media_type"), F.lit("t").alias("title"), F.lit("").alias("description"), F.lit(f"{H}/0").alias("canonical"), F.when(F.col("id") == 0, "noindex").alias("robots"), F.lit("b").alias("body_hash"), F.array(F.lit("x")).alias("redirect_chain"), F.array(F.struct(F.lit("en").alias("lang"), F.lit(f"{H}/0").alias("url"))).alias("hreflangs"))
    edges = pages.select(F.col("url").alias("src"), F.lit(f"{H}/0").alias("dst"), F.lit(False).alias("nofollow"))
    got = {k: v for (k, _), v in found(pages, edges).items()}
    assert got == {"site.duplicate_title": 1, "site.duplicate_content": 1, "site.orphan_pages": n - 1, "site.canonical_to_nonindexable": n - 1, "site.hreflang_to_nonindexable": n, "site.hreflang_no_return_link": n - 1}
