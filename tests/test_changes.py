"""The change feed: batches of pages streamed in against the difference of batch runs; restarts, late and repeated captures."""

from pyspark.sql import functions as F

from pagelake.operators import page_checks as C
from pagelake.plans.page_queries import damaged
from pagelake.streaming.changes import change_feed, follow, page_codes, standing, wait

SF, ASKED = "/root/testdata/sf0.001", ("indexability", "canonical", "description", "schema", "forms")


def run(spark, tmp_path):
    wait(follow(change_feed(spark, str(tmp_path / "in"), *ASKED), str(tmp_path / "out"), str(tmp_path / "check")))
    return spark.read.parquet(str(tmp_path / "out"))


def put(pages, capture, tmp_path):
    pages.select("page_id", "url", "html", F.lit(capture).cast("long").alias("capture")).write.mode("append").parquet(str(tmp_path / "in"))


def codes(pages):
    return {(r.url, c) for r in page_codes(pages.select("page_id", "url", "html", F.lit(1).alias("capture")), *ASKED).collect() for c in r.codes}


def test_changes_are_the_difference_of_the_batches(spark, tmp_path):
    """Two batches, the query ended and begun anew from its checkpoint between them."""
    plain = spark.read.parquet(f"{SF}/pages.parquet").dropDuplicates(["url"])
    worse = damaged(plain)
    put(plain, 1, tmp_path)
    first = run(spark, tmp_path)
    before = codes(plain)
    assert {(r.url, r.code) for r in first.collect()} == before and first.where("change <> 'introduced'").isEmpty()
    put(worse, 2, tmp_path)
    both = run(spark, tmp_path)
    after = codes(worse)
    got = {(r.url, r.code, r.change) for r in both.where("capture = 2").collect()}
    assert got == {(*x, "fixed") for x in before - after} | {(*x, "introduced") for x in after - before} and after - before and before - after
    assert {(r.url, r.code) for r in standing(both).collect()} == after
    assert run(spark, tmp_path).count() == both.count()  # nothing new has arrived


def test_late_repeated_and_null_captures(spark, tmp_path):
    long = "x" * 200_000
    bad, good = "<html><head><meta name='robots' content='noindex'></head><body>a</body></html>", "<html><head></head><body>a</body></html>"
    rows = lambda *r: spark.createDataFrame(list(r), "page_id long, url string, html string, capture long")
    into = lambda df: df.write.mode("append").parquet(str(tmp_path / "in"))
    into(rows((1, "https://a/", good, 5), (1, "https://a/", bad, 6), (1, "https://a/", good, 4), (2, None, bad, 1), (3, "https://c/", None, 1), (4, "https://d/", bad + long, 1)))
    noindex = lambda df: sorted(((r.url or "", r.capture, r.change) for r in df.where("code = 'robots.noindex'").collect()))
    one = [("", 1, "introduced"), ("https://a/", 6, "introduced"), ("https://d/", 1, "introduced")]
    assert noindex(run(spark, tmp_path)) == one
    into(rows((1, "https://a/", good, 3), (4, "https://d/", bad + long, 2)))  # too late; the same again
    assert noindex(run(spark, tmp_path)) == one
    into(rows((1, "https://a/", good, 7), (2, None, None, 2)))
    assert noindex(run(spark, tmp_path)) == sorted([*one, ("https://a/", 7, "fixed"), ("", 2, "fixed")])


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string, capture long").write.parquet(str(tmp_path / "in"))
    assert change_feed(spark, str(tmp_path / "in"), "title").isStreaming and set(C.CHECKS) >= {"title"}
