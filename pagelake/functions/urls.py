"""URL keys and shapes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def normalise(url: Column) -> Column:
    """Scheme and host lower-cased, default port and fragment dropped, empty path as /."""
    at = netloc(url)
    at = F.when(scheme(url) == "https", F.regexp_replace(at, ":443$", "")).when(scheme(url) == "http", F.regexp_replace(at, ":80$", "")).otherwise(at)
    p = path(url)
    return F.concat(scheme(url), F.lit("://"), at, F.when(p == "", "/").otherwise(p), query(url))


def registrable(name: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(name, ".", -2)


def shape(url: Column) -> Column:
    """Codes of the shape of a URL."""
    p = path(url)
    codes = F.array(
        F.when(F.contains(p, F.lit("_")), "url.underscore"),
        F.when(F.contains(p, F.lit(" ")) | F.contains(p, F.lit("%20")), "url.space"),
        F.when(F.contains(p, F.lit("//")), "url.double_slash"),
        F.when(F.length(url) > 200, "url.long"),
    )
    return F.array_compact(codes)


def _settled(p: Column) -> Column:
    """A path without . and .. segments; as many .. as there are lead up to the root."""
    parts = F.split(p, "/", -1)

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(x == "..", up).when(x == ".", kept).otherwise(F.array_append(kept, x))

    last = F.element_at(parts, -1)
    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    walked = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(walked, "/")).otherwise(p)


def join(base: Column, href: Column) -> Column:
    """The URL that a reference on a page leads to."""
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    bare, tail = F.regexp_replace(base, "[?#].*$", ""), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own = F.regexp_replace(href, "[?#].*$", "")
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    return (
        F.when(href == "", base).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href)).when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("/"), F.concat(root, _settled(own), tail)).otherwise(F.concat(root, _settled(F.concat(folder, own)), tail))
    )
