"""Sitemaps as they were captured: bytes, packed or not, in any of the usual encodings, XML or plain text.

Bytes that are UTF-8 as they lie never leave the JVM; only packed files and other encodings go through a
small helper. XML is read by Spark's own parser, with a field for what is not well formed.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelake.functions import urls as U

# The most that a sitemap may hold.
MOST_BYTES, MOST_URLS, MOST_CHILDREN = 50 << 20, 50_000, 1000
#: Bytes in which a declaration of the encoding is looked for.
_HEAD = 1024
_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)|<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_-]+)""", re.I)
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_XML = "url ARRAY<STRUCT<loc: ARRAY<STRING>>>, sitemap ARRAY<STRUCT<loc: ARRAY<STRING>>>, broken STRING"


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, content) of the files under a path, a row a file, as bytes: packed files stay packed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("url"), "content")


def text_of(raw: bytes | None, charset: str | None = None) -> str | None:
    """Bytes as text: unpacked if they begin like gzip, read by their byte order mark, `charset`, what they declare, or UTF-8.

    None for a null, a packed file that is cut off or broken, and one of over MOST_BYTES. What the encoding does not know is U+FFFD.
    """
    if raw is None:
        return None
    if raw[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        try:
            raw = unpack.decompress(raw, MOST_BYTES + 1)
        except zlib.error:
            return None
        if not unpack.eof:
            return None
    if len(raw) > MOST_BYTES:
        return None
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    declared = _DECLARED.search(raw[:_HEAD])
    name = charset or (next(x for x in declared.groups() if x).decode("ascii") if declared else "utf-8")
    try:
        return raw.decode(name, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def _texts(raw: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([text_of(x, c) for x, c in zip(raw, charset, strict=True)], dtype=object)


def decoded(content: Column, charset: Column | None = None) -> Column:
    """A captured body as text, as text_of has it; a body that is neither packed nor in another encoding takes no detour."""
    named = charset if charset is not None else F.lit(None).cast("string")
    head = F.hex(F.substring(content, 1, 3))
    low = F.lower(F.make_valid_utf8(F.substring(content, 1, _HEAD).cast("string")))
    other = F.regexp_extract(low, r"""(?:^\s*<\?xml[^>]*?encoding\s*=\s*["']|<meta[^>]+charset\s*=\s*["']?\s*)([a-z0-9._-]+)""", 1)
    utf8 = lambda c: F.coalesce(F.lower(c), F.lit("")).isin("", "utf-8", "utf8", "us-ascii")
    plain = ~head.rlike("^(1F8B|FFFE|FEFF)") & utf8(named) & ((head == "EFBBBF") | utf8(other) | named.isNotNull())
    body = F.when(head == "EFBBBF", F.substring(content, 4, MOST_BYTES + 1)).otherwise(content)
    native = F.when(F.octet_length(content) <= MOST_BYTES, F.make_valid_utf8(body.cast("string")))
    return F.when(plain, native).otherwise(_texts(F.when(~plain, content), named))


def entries(files: DataFrame) -> DataFrame:
    """files(site, url, content[, charset]) -> (site, file, kind, pos, loc, error): a row an entry, or one for a file without any.

    kind is urlset, index, text or unknown. An entry without an address, one whose address is relative, a
    file that cannot be read, is not well formed, or holds more than it may, has an error; what can be read of it is there all the
    same, and nothing is cut off. Addresses are normalised.
    """
    charset = F.col("charset") if "charset" in files.columns else None
    df = files.select("site", F.col("url").alias("file"), F.col("content").isNull().alias("lost"), decoded(F.col("content"), charset).alias("body"))
    df = df.withColumn("x", F.from_xml("body", _XML, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}))
    head = F.substring("body", 1, 4096)
    tag = lambda name: head.rlike(rf"(?i)<(\w+:)?{name}\b")
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike("^http"))
    kind = F.when(tag("sitemapindex"), "index").when(tag("urlset"), "urlset").when(F.size(lines) > 0, "text").otherwise("unknown")
    # what is not well formed is read as far as its tags go
    loose = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    strict = lambda c: F.transform(c, lambda e: F.coalesce(F.trim(F.get(e["loc"], 0)), F.lit("")))
    broken = F.col("x.broken").isNotNull()
    df = df.withColumn("kind", kind)
    found = F.when(F.col("kind") == "text", lines).when(F.col("kind") == "unknown", None).when(broken, loose).when(F.col("kind") == "index", F.filter(strict(F.col("x.sitemap")), lambda x: x != "")).otherwise(strict(F.col("x.url")))
    df = df.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    most = F.when(F.col("kind") == "index", MOST_CHILDREN).otherwise(MOST_URLS)
    whole = F.when(F.col("lost"), "could not be fetched").when(F.col("body").isNull(), "cannot be unpacked, or is larger than the 50 MB a sitemap may have").when(F.col("kind") == "unknown", "is neither valid XML nor a plain list of URLs").when(broken & (F.col("kind") != "text"), "is not well formed").when(F.size("found") > most, "lists more than a sitemap may")
    each = F.transform("found", lambda x, i: F.struct(i.alias("pos"), x.alias("raw"), F.when(x == "", "a <url> entry has no <loc>").when(~x.rlike("^https?://"), F.concat(F.lit("relative URL in <loc>: "), F.substring(x, 1, 80))).alias("error")))
    none = F.array().cast("array<struct<pos:int,raw:string,error:string>>")
    own = F.when(whole.isNotNull(), F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("raw"), whole.alias("error")))).otherwise(none)
    rows = df.select("site", "file", F.when(F.col("lost"), "missing").otherwise(F.col("kind")).alias("kind"), F.inline(F.concat(own, each)))
    return rows.select("site", "file", "kind", "pos", F.when(F.col("error").isNull(), U.normalise(F.col("raw"))).alias("loc"), "error")


def tree(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of all captured files, and roots(site, file) -> (site, kind, loc, error): the addresses that the roots declare, an index followed one level.

    A child that was not captured, and an index in an index, are errors. A child that several indexes of a site list is read once for each.
    """
    # a few files stand for many entries, so the files are joined and the entries follow by their file
    top = found.join(roots, ["site", "file"], "left_semi")
    listed = top.where("kind = 'index' AND loc IS NOT NULL").select("site", F.col("loc").alias("file"))
    below = listed.join(found.withColumn("at", U.normalise(F.col("file"))).drop("file").withColumnRenamed("at", "file"), ["site", "file"], "left")
    nested = F.col("kind") == "index"
    child = below.select(
        "site", F.coalesce("kind", F.lit("missing")).alias("kind"), F.when(~nested, F.col("loc")).alias("loc"),
        F.when(F.col("kind").isNull(), F.concat("file", F.lit(": could not be fetched"))).when(nested & F.col("loc").isNotNull(), F.concat(F.lit("nests more than one level deep at "), "loc")).when(F.col("error").isNotNull(), F.concat("file", F.lit(": "), "error")).alias("error"),
    )
    own = top.where("kind <> 'index' OR error IS NOT NULL").select("site", "kind", "loc", "error")
    return own.unionAll(child)
