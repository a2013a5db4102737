from pagelake.operators import page_checks as C
from pagelake.streaming import stream_findings, write_table


def test_stream_ends_with_the_batch_result(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    src = str(tmp_path / "in")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.write.parquet(src)
    q = write_table(stream_findings(spark, src, ("title", "content")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = sorted((r.page_id, r.code) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.page_id, r.code) for r in C.findings(C.prepared(C.captured(pages)), "title", "content").collect())
    assert got == want and got
