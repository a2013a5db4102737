"""Sitemaps as bytes: files on disk in all forms, and what is wrong with them."""

import gzip

import pytest
from pyspark.sql import functions as F

from pagelake.sources import sitemaps as S

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
ONE = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset {NS}><url><loc>https://a.test/é?x=1&amp;y=2</loc></url></urlset>'


@pytest.mark.parametrize("raw,charset,want", [
    (None, None, None), (b"", None, ""), ("café".encode(), None, "café"), (b"\xef\xbb\xbfcaf\xc3\xa9", None, "café"), ("café".encode("utf-16"), None, "café"), (b"\xfe\xff" + "café".encode("utf-16-be"), None, "café"), ("café".encode("latin-1"), "iso-8859-1", "café"),
    (b'<?xml version="1.0" encoding="ISO-8859-1"?>\xe9', None, '<?xml version="1.0" encoding="ISO-8859-1"?>é'), (b'<META CHARSET=windows-1252>\x80', None, "<META CHARSET=windows-1252>€"), (gzip.compress("é".encode()), None, "é"), (gzip.compress("é".encode("utf-16")), None, "é"),
    (gzip.compress(b"x" * 1000)[:-9], None, None), (b"\x1f\x8bnot packed", None, None), (b"caf\xe9", None, "caf�"), (b"x", "no-such-charset", "x"), (b"\x00\x01", None, "\x00\x01"), (b'<meta charset="no-such">x', None, '<meta charset="no-such">x'), (b"a" * 3_000_000, None, "a" * 3_000_000),
])
def test_bytes(spark, raw, charset, want):
    """The column gives what the helper gives, whichever way a body takes."""
    assert S.text_of(raw, charset) == want
    df = spark.createDataFrame([(raw, charset)], "raw binary, charset string")
    assert df.select(S.decoded(F.col("raw"), F.col("charset")).alias("t")).first().t == want


def test_too_large(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BYTES", 100)
    assert S.text_of(b"a" * 101) is None and S.text_of(gzip.compress(b"a" * 101)) is None and S.text_of(b"a" * 100) == "a" * 100
    df = spark.createDataFrame([("s", "u", bytearray(b"http://a.test/" + b"a" * 100))], "site string, url string, content binary")
    assert [r.error for r in S.entries(df).collect()] == ["cannot be unpacked, or is larger than the 50 MB a sitemap may have"]


def test_files_on_disk(spark, tmp_path):
    """Plain, packed without a suffix, utf-16, and an index; read as binary files."""
    files = {"plain.xml": ONE.encode(), "packed.xml": gzip.compress(ONE.encode()), "wide.xml": ONE.replace("UTF-8", "UTF-16").encode("utf-16"), "list.txt": b"# urls\r\n https://b.test \r\nhttps://b.test/2\n", "deep/packed.gz": gzip.compress(ONE.encode())}
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = S.entries(S.sitemap_files(spark, str(tmp_path)).withColumn("site", F.lit("s")))
    found = {r.file.rpartition("/")[2]: [] for r in got.collect()}
    for r in got.orderBy("file", "pos").collect():
        assert r.error is None
        found[r.file.rpartition("/")[2]].append((r.kind, r.loc))
    assert found == {n: [("urlset", "https://a.test/é?x=1&y=2")] for n in ("plain.xml", "packed.xml", "wide.xml", "packed.gz")} | {"list.txt": [("text", "https://b.test/"), ("text", "https://b.test/2")]}


def test_errors_and_index(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_URLS", 4)
    wrap = lambda x: f"<urlset {NS}>{x}</urlset>"
    url = lambda u: f"<url><loc>{u}</loc></url>"
    files = [
        ("s", "https://s.test/i.xml", f"<sitemapindex {NS}><sitemap><loc>https://s.test/1.xml</loc></sitemap><sitemap><loc> https://s.test/2.xml </loc></sitemap><sitemap></sitemap></sitemapindex>"),
        ("s", "https://s.test/1.xml", wrap(url("https://s.test/a") + url("rel") + "<url></url>" + url("<![CDATA[https://s.test/b]]>"))), ("s", "https://s.test/2.xml", f"<sitemapindex><sitemap><loc>https://s.test/3.xml</loc></sitemap></sitemapindex>"),
        ("t", "https://t.test/m.xml", wrap(url("https://t.test/1") + "<url><loc>https://t.test/2</loc>")[:-9]), ("u", "https://u.test/m.xml", "nothing of use"), ("v", "https://v.test/m.xml", ""), ("w", "https://w.test/m.xml", None), ("x", "https://x.test/m.xml", wrap("")),
        ("y", "https://y.test/m.xml", wrap("".join(url(f"https://y.test/{i}") for i in range(5)))), ("z", "https://z.test/m.xml", '<n:urlset xmlns:n="x"><n:url><n:loc>https://z.test/p</n:loc></n:url></n:urlset>'),
    ]
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c.encode()), 1) for a, b, c in files], "site string, url string, content binary, kind int")
    roots = spark.createDataFrame([(a, b) for a, b, _ in files if not b.startswith("https://s.test/") or b.endswith("i.xml")], "site string, file string")
    got = {}
    for r in S.tree(S.entries(df), roots).collect():
        got.setdefault(r.site, set()).add((r.kind, r.loc, r.error))
    assert got == {
        "s": {("urlset", "https://s.test/a", None), ("urlset", "https://s.test/b", None), ("urlset", None, "https://s.test/1.xml: relative URL in <loc>: rel"), ("urlset", None, "https://s.test/1.xml: a <url> entry has no <loc>"), ("index", None, "nests more than one level deep at https://s.test/3.xml")},
        "t": {("urlset", None, "is not well formed"), ("urlset", "https://t.test/1", None), ("urlset", "https://t.test/2", None)}, "u": {("unknown", None, "is neither valid XML nor a plain list of URLs")}, "v": {("unknown", None, "is neither valid XML nor a plain list of URLs")},
        "w": {("missing", None, "could not be fetched")}, "y": {("urlset", None, "lists more than a sitemap may"), *(("urlset", f"https://y.test/{i}", None) for i in range(5))}, "z": {("urlset", "https://z.test/p", None)},
    }
    assert S.entries(df.limit(0)).isEmpty()
