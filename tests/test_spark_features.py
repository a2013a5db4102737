"""Table functions, observed invariants, differences of long texts, lists as of a moment."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.functions import table_functions as L
from pagelake.operators import chunks as K
from pagelake.operators import geo_score as G
from pagelake.operators import index_lists as I
from pagelake.operators import observed as O
from pagelake.operators import page_checks as C
from pagelake.operators import site as S
from pagelake.operators import text_difference as D

SF = "/root/testdata/sf0.001"
PROSE = "One two three four five six seven eight nine ten. " * 6
PAGES = [
    (1, f'<h1>One</h1><p>First text here.</p><p>Second bold text.</p><h2>Two</h2><ul><li>An item of it</li></ul><script type="application/ld+json">{{"@graph": [{{"@type": "Product", "name": "P"}}, {{"@type": ["Article", "https://schema.org/NewsArticle"], "author": {{"@type": "Person"}}}}]}}</script><script type="application/ld+json">{{"@type": "Thing",}}</script>'),
    (2, None), (3, ""), (4, '<script type="application/ld+json">[{"@type": "FAQPage", "name": ["x"]}, 5, {"@type": null}]</script>'), (5, f"<main><p>{PROSE}</p><p>{PROSE * 5}</p></main><nav><p>not this</p></nav>"), (6, "plain words without any block at all"),
]


def test_table_functions(spark):
    L.register(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    got = spark.sql("SELECT page_id, c.* FROM {p} p, LATERAL chunks(p.html) c", p=pages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.page_chunks(pages).collect())) and got.columns == ["page_id", "ord", "heading", "text", "start", "stop", "source"]
    short = spark.sql("SELECT page_id, c.* FROM {p} p, LATERAL chunks(p.html, 40) c", p=pages)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, K.page_chunks(pages, 40).collect()))
    nodes = [(r.page_id, r.block, r.ord, r.type, r.name, r.error) for r in spark.sql("SELECT page_id, j.* FROM {p} p, LATERAL jsonld(p.html) j ORDER BY ALL", p=pages).collect()]
    assert sorted(nodes, key=str) == sorted([(1, 0, 0, "Product", "P", None), (1, 0, 1, "Article", None, None), (1, 0, 1, "NewsArticle", None, None), (1, 0, 2, "Person", None, None), (1, 1, -1, None, None, "JSONDecodeError"), (4, 0, 0, "FAQPage", None, None)], key=str)
    # in a plan with other operators, and with nothing to read
    assert spark.sql("SELECT type, count(*) AS n FROM {p} p, LATERAL jsonld(p.html) j WHERE error IS NULL GROUP BY type", p=pages).count() == 5
    assert spark.sql("SELECT * FROM {p} p, LATERAL chunks(p.html) c", p=pages.limit(0)).isEmpty()


def flags(rows):
    return {n: ok for _, n, ok, _ in rows}


def test_invariants_hold_of_pages(spark):
    facts = C.prepared(C.captured(spark.read.parquet(f"{SF}/pages.parquet")))
    rows = O.settled(O.ordered_findings(facts), "page.audit", O.page_audit())
    assert all(ok and n == 50 for *_, ok, n in rows) and len(rows) == 4
    assert all(ok for *_, ok, _ in O.settled(G.geo_score(G.geo_signals(facts)), "geo.score", O.geo_score()))


BROKEN = [
    ("page_audit", "status int, findings array<struct<rank:int,code:string,severity:string>>", [
        ((200, [(0, "a.b", "critical"), (2, "a.c", "low")]), ()), ((None, []), ("page_was_fetched",)), ((200, [(0, "nodot", "critical")]), ("findings_have_codes",)),
        ((200, [(9, "a.b", "grave")]), ("severities_known",)), ((200, [(2, "a.b", "low"), (0, "a.c", "critical")]), ("findings_ordered_by_severity",))]),
    ("geo_score", "score long, possible long, band string", [((50, 100, "good"), ()), ((101, 200, "good"), ("score_in_range",)), ((60, 58, "good"), ("score_within_possible",)), ((5, 58, "awful"), ("band_known",))]),
    ("site_graph", "score double, inbound long, outbound long", [((1.0, 1, 0), ()), ((-1.0, 1, 0), ("ranks_not_negative", "ranks_sum_to_one")), ((0.5, 1, 1), ("ranks_sum_to_one",)), ((1.0, 0, 0), ("nodes_have_links",))]),
    ("audit_diff", "code string, change string, before long, after long", [(("a.b", "fixed", 1, None), ()), (("a.b", "fixed", 1, 1), ("sides_agree_with_change",)), (("a.b", "gone", 1, 1), ("change_known",)), (("", "remaining", 1, 1), ("codes_named",)), (("a", "introduced", 1, None), ("sides_agree_with_change",))]),
    ("content_charts", "detected long, chartable long, figures long, html string, jsonld string", [((2, 1, 1, "t", "j"), ()), ((0, 0, 0, None, None), ()), ((1, 2, 0, None, None), ("chartable_are_detected",)), ((2, 2, 1, None, "j"), ("table_follows_figures",)), ((2, 0, 1, "t", "j"), ("no_table_without_figures",))]),
]


@pytest.mark.parametrize("service,ddl,cases", BROKEN, ids=[b[0] for b in BROKEN])
def test_a_planted_violation_turns_its_flag(spark, service, ddl, cases):
    for row, turned in cases:
        rows = O.settled(spark.createDataFrame([row], ddl), service, getattr(O, service)())
        assert tuple(n for n, ok in flags(rows).items() if not ok) == turned and rows[0][3] == 1


def test_flags_come_from_the_pass_that_writes(spark, tmp_path):
    df = spark.createDataFrame([(50, 100, "good"), (10, 5, "critical")], "score long, possible long, band string")
    rows = O.settled(df, "geo.score", O.geo_score(), lambda r: r.write.parquet(str(tmp_path / "out")))
    assert flags(rows) == {"score_in_range": True, "score_within_possible": False, "band_known": True} and spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert all(ok and n == 0 for *_, ok, n in O.settled(df.limit(0), "geo.score", O.geo_score()))


def test_difference_of_texts(spark):
    """Against sets of strings; nulls, empty and short texts, and a text of a million words."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(3000)]
    long = [f"w{i % 70_001}" for i in range(1_000_000)]
    pairs = [(1, " ".join(words), " ".join(words[:1500] + ["new"] + words[1500:])), (2, None, "one two"), (3, "one two", None), (4, "", ""), (5, "one two", "one two"), (6, "a b c d e f g h", "a b c d e f g h i"), (7, " ".join(words), " ".join(words)), (8, " ".join(long[:-1]), " ".join([*long, "end"])), (9, None, None)]

    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)} if len(w) >= 8 else {tuple(w)} if w else set()

    got = {r.id: (r.only_share, r.runs) for r in D.only_share(spark.createDataFrame(pairs, "id long, before string, after string")).collect()}
    assert set(got) == {p[0] for p in pairs}
    for i, a, b in pairs:
        x, y = runs(a), runs(b)
        assert got[i][1] == len(y) and got[i][0] == pytest.approx(len(y - x) / max(1, len(y)), abs=0.00051)


def test_lists_as_of_a_moment(spark):
    """Ties, broken and empty answers, nothing before, over bucket ends, fresh and stale; against a loop."""
    rng = random.Random(7)
    good = lambda k: f'[{{"id":"CC-{k}","api":"u"}},{{"id":"CC-{k + 1}"}},{{"api":"x"}}]'
    fetches = [(s, rng.randrange(20_000), rng.choice([good(rng.randrange(90)), "[]", "[{", None, '{"id":"z"}', "", "[1]", "[null]"])) for s in "aab" for _ in range(120)] + [("c", 100, good(1)), ("c", 100, good(3)), ("d", 5, "[]")]
    asked = [(i, rng.choice("aabcde"), rng.randrange(21_000)) for i in range(200)] + [(900, "c", 100), (901, "c", 99), (902, None, 5)]
    at = lambda df: df.withColumn("at", F.timestamp_seconds(F.col("at")))
    out = I.lists_as_of(at(spark.createDataFrame(fetches, "source string, at long, body string")), at(spark.createDataFrame(asked, "id int, source string, at long")), 300, 1000)
    got = {r.id: (r.state, [x.id for x in r.indexes] if r.indexes else None) for r in out.collect()}
    assert len(got) == len(asked)
    for i, s, t in asked:
        before = [(u, int(b[11:].split('"')[0])) for x, u, b in fetches if x == s and u <= t and b and b.startswith('[{"id')]
        if not before:
            assert got[i] == ("unavailable", None)
            continue
        u = max(u for u, _ in before)
        ks = [k for v, k in before if v == u]
        state, ids = got[i]
        assert state == ("fresh" if t - u <= 300 else "stale") and ids in [sorted((f"CC-{k + 1}", f"CC-{k}"), reverse=True) for k in ks]
    assert got[900][1] == ["CC-4", "CC-3"]


def test_index_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url":"https://a/1","status":"200","mime":"text/html"}\n\n{"url":"https://a/1","status":404}\nnot json\n{"url":"https://a/2","sta\n   \n{"status":"301","mime":null}\n')
    (r,) = I.capture_summary(I.index_lines_of(spark, str(tmp_path))).collect()
    assert (r.captures, r.status_2xx, r.html, r.urls, r.malformed) == (3, 1, 1, 1, 2)
    assert I.capture_summary(spark.createDataFrame([], "key string, line string")).isEmpty()


def test_invariants_hold_of_many_small_ranks(spark):
    """Ranks of so many nodes that five places do not show them."""
    ring = spark.range(30_000).selectExpr("id AS src", "(id + 1) % 30000 AS dst")
    rows = O.settled(S.ranked_exactly(ring), "site.graph", O.site_graph())
    assert all(ok and n == 30_000 for *_, ok, n in rows)
    assert not flags(O.settled(S.pagerank(ring).selectExpr("*", "1 AS inbound", "1 AS outbound"), "site.graph", O.site_graph()))["ranks_sum_to_one"]
