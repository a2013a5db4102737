"""Sitemaps that list the pages, written in all the ways in which sitemaps come, and read back."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagelake.sources import sitemaps as S
from pagelake.sources.tables import scratch_folder

from .page_queries import _F, _pages

#: The sites that the pages are dealt out to, and the ways in which a site's sitemap is written.
SITES, WAYS = 40, 8
_NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'


@F.pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode(), mtime=0), na_action="ignore")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, way, name, url, page_id): the file that each page is listed in; a site of way 6 has two files under an index."""
    site = F.col("page_id") % SITES
    way = site % WAYS
    name = F.when(way == 6, F.when(F.floor(F.col("page_id") / SITES) % 2 == 0, "a").otherwise("b")).otherwise("sitemap")
    return _pages(spark, sf_dir).select(site.alias("site"), way.alias("way"), name.alias("name"), "url", "page_id")


def _bodies(listed: DataFrame) -> DataFrame:
    """(site, way, name, body): the text of each file; files of a sitemap are small by its own rules."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.when(F.col("way") == 5, F.col("url")).when(F.col("way") == 4, F.concat(F.lit("<url><loc> <![CDATA["), "url", F.lit("]]> </loc></url>"))).otherwise(F.concat(F.lit("<url><loc>\n"), escaped, F.lit("</loc><image:image><image:loc>https://i.test/x</image:loc></image:image></url>")))
    g = listed.groupBy("site", "way", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("e"))
    odd = "<url><loc>/relative</loc></url><url><lastmod>2020-01-01</lastmod></url>"
    encoding = F.when(F.col("way") == 4, "ISO-8859-1").when(F.col("way") == 3, "UTF-16").otherwise("UTF-8")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="'), encoding, F.lit(f'"?>\n<urlset {_NS}>'), F.when(F.col("way") == 0, odd).otherwise(""), "e", F.when(F.col("way") == 7, "").otherwise("</urlset>"))
    return g.select("site", "way", "name", F.when(F.col("way") == 5, F.concat(F.lit("a list\n"), "e")).otherwise(xml).alias("body"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, content): the files of the sites; some lie as files, some in a table of captured bytes."""
    bodies, folder = _bodies(_listed(spark, sf_dir)), scratch_folder(spark, "sitemaps")
    one = bodies.repartition("site", "name")
    for kind, way in (("none", 0), ("gzip", 1)):
        one.where(F.col("way") == way).select("site", F.col("body").alias("value")).write.partitionBy("site").option("compression", kind).text(f"{folder}/{kind}")
    lying = S.sitemap_files(spark, f"{folder}/none").unionAll(S.sitemap_files(spark, f"{folder}/gzip")).where("url RLIKE '/part-'").select(F.regexp_extract("url", r"/site=(\d+)/", 1).cast("long").alias("site"), F.lit("sitemap").alias("name"), "content")
    raw = F.when(F.col("way") == 2, _packed(F.when(F.col("way") == 2, F.col("body")))).when(F.col("way") == 3, F.encode("body", "UTF-16")).when(F.col("way") == 4, F.encode("body", "ISO-8859-1")).otherwise(F.col("body").cast("binary"))
    table = bodies.where("way > 1").select("site", "name", raw.alias("content"))
    link = lambda x: f"<sitemap><loc>https://s.test/{x}.xml</loc></sitemap>"
    index = bodies.where("way = 6").select("site").distinct().select("site", F.lit("sitemap").alias("name"), F.lit(f"<sitemapindex {_NS}>{link('a')}{link('b')}{link('c')}{link('sitemap')}</sitemapindex>").cast("binary").alias("content"))
    return lying.unionAll(table).unionAll(index).select("site", F.concat(F.lit("https://s.test/"), "name", F.lit(".xml")).alias("url"), "content")


def sitemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sitemap of each site declares, files below an index included."""
    files = _written(spark, sf_dir)
    roots = _listed(spark, sf_dir).select("site", F.lit("https://s.test/sitemap.xml").alias("file")).distinct()
    return S.tree(S.entries(files), roots)


def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's html as captured bytes in one of several encodings, named by a mark, the caller, the page or not at all."""
    n = F.col("page_id") % 6
    text = F.concat(F.when(n == 3, '<meta charset="ISO-8859-1">').otherwise(""), F.translate("url", "/", "é"), F.lit(" "), F.regexp_replace("html", r"[^\x{00}-\x{FF}]|charset", "?"))
    raw = F.when(n == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(n == 1, F.encode(text, "UTF-16")).when(n == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(n.isin(3, 4), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return _pages(spark, sf_dir).select("page_id", S.decoded(raw, F.when(n == 4, "iso-8859-1")).alias("text"))


QUERIES = {f.__name__: f for f in (sitemap_parse, decode_bytes)}
KEY = "scheme || '://' || CASE WHEN scheme = 'https' THEN regexp_replace(netloc, ':443$', '') ELSE regexp_replace(netloc, ':80$', '') END || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
ORACLE_SQL = {
    "sitemap_parse": f"""WITH {_F}, p AS (SELECT page_id % {SITES} AS site, page_id % {SITES} % {WAYS} AS way, page_id // {SITES} % 2 AS half, {KEY} AS loc FROM u), w AS (SELECT DISTINCT site, way FROM p)
    SELECT site, CASE way WHEN 5 THEN 'text' ELSE 'urlset' END AS kind, loc, NULL AS error FROM p
    UNION ALL SELECT site, 'urlset', NULL, unnest(['a <url> entry has no <loc>', 'relative URL in <loc>: /relative']) FROM w WHERE way = 0
    UNION ALL SELECT site, 'urlset', NULL, 'is not well formed' FROM w WHERE way = 7
    UNION ALL SELECT site, 'missing', NULL, 'https://s.test/c.xml: could not be fetched' FROM w WHERE way = 6
    UNION ALL SELECT w.site, 'missing', NULL, 'https://s.test/' || n || '.xml: could not be fetched' FROM w, (VALUES ('a', 0), ('b', 1)) AS x(n, half) WHERE way = 6 AND NOT EXISTS (SELECT 1 FROM p WHERE p.site = w.site AND p.half = x.half)
    UNION ALL SELECT site, 'index', NULL, 'nests more than one level deep at https://s.test/' || unnest(['a', 'b', 'c', 'sitemap']) || '.xml' FROM w WHERE way = 6""",
    "decode_bytes": "SELECT page_id, CASE WHEN page_id % 6 = 3 THEN '<meta charset=\"ISO-8859-1\">' ELSE '' END || translate(url, '/', 'é') || ' ' || regexp_replace(html, '[^\\x{00}-\\x{FF}]|charset', '?', 'g') AS text FROM pages",
}
