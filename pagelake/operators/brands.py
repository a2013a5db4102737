"""Brands in recorded answers: the names a site goes by, where answers name them, and how often.

Any number of brands meets any number of answers through an index: an alias can only stand in a text that
has its first two words next to each other as whole words, or its only one, a host only in one that has the characters around its first dot. Answers
and names meet by these keys, dealt out to several tasks each, and only the pairs that share a key are
looked at with a regex. A name that many brands go by is looked for once in an answer; brands meet what was found.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.operators import market as M
from pagelake.sources.tables import scratch_folder

# Labels of a host that name no brand.
NOT_BRANDS = ("www", "com", "org", "net", "io", "dev", "app", "co", "ai", "xyz")
# What parts a title from the name of its site.
SEPARATORS = "[|\\-–—•]"
#: Names taken from each block of structured data.
_NAMES = 4
# How an answer says that it does not know.
DISCLAIMS = r"(?i)\b(?:i (?:do not|don't) (?:have|know)|no information|not familiar|unable to find|cannot find|as of my (?:last )?(?:knowledge|training|update))\b"
#: Tasks that a key's answers are dealt out to.
SALTS = 16
#: Brands whose names are sent to all tasks at a time.
BRANDS = 100_000
_STRIP = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$"


def _strip(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), _STRIP, "")


def brand_label(host: Column) -> Column:
    """The first label of a host that can be a name; the host itself if none can."""
    return F.coalesce(F.try_element_at(F.filter(F.split(host, r"\."), lambda p: ~p.isin(*NOT_BRANDS)), F.lit(1)), host)


def brand_names(facts: DataFrame, explicit: Column | None = None) -> DataFrame:
    """Facts of pages -> (page_id, brand, aliases, host): what each page's site calls itself, and its names in order.

    Names come from og:site_name, from the structured data, from behind the last separator of the title, then
    the host's label and the host; names that differ in case alone are one. The brand is `explicit`, or the first
    name that the site states, or the label.
    """
    host = F.coalesce(U.host(F.col("url")), F.lit(""))
    label = brand_label(host)
    site = F.transform(F.filter("metas", lambda m: m["property"] == "og:site_name"), lambda m: _strip(m["content"]))
    declared = F.flatten(F.transform("jsonld", lambda j: F.transform(F.slice(F.regexp_extract_all(j, F.lit(r'"name"\s*:\s*"([^"]{2,60})"'), F.lit(1)), 1, _NAMES), lambda x: _strip(x))))
    parts = F.split(F.coalesce(F.try_element_at("titles", F.lit(1)), F.lit("")), SEPARATORS)
    tail = F.when(F.size(parts) > 1, F.array(_strip(F.element_at(parts, -1)))).otherwise(F.array().cast("array<string>"))
    stated = F.filter(F.concat(site, declared, tail), lambda x: x != "")
    own = F.coalesce(F.nullif(_strip(explicit), F.lit("")) if explicit is not None else F.lit(None).cast("string"), F.try_element_at(stated, F.lit(1)), label)
    df = facts.select("page_id", own.alias("brand"), stated.alias("stated"), label.alias("label"), host.alias("host"))
    names = F.filter(F.concat(F.array("brand"), "stated", F.array("label", "host")), lambda x: x != "")
    df = df.withColumn("names", names).withColumn("low", F.transform("names", lambda x: F.lower(x)))
    first = F.filter("names", lambda x, i: F.array_position(F.col("low"), F.lower(x)) == i + 1)
    return df.select("page_id", "brand", first.alias("aliases"), "host")


def _fold(x: Column) -> Column:
    """What letters that match each other in either case have in common."""
    return F.lower(F.upper(F.translate(x, "İ", "i")))


def _words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)(\w+)"), F.lit(1))


def _dots(low: Column, before: int) -> Column:
    """What stands around each dot: so many characters before it, and one after."""
    return F.transform(F.regexp_extract_all(low, F.lit(rf"(?s)(?=(.{{{before}}}\..))"), F.lit(1)), lambda x: F.concat(F.lit("."), x))


def _pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def answer_keys(text: Column, words: Column) -> Column:
    """All keys that a name standing in the text could have; words: those of the text, folded."""
    low = F.lower(text)
    dots = F.when(F.contains(text, F.lit(".")), F.concat(*(_dots(low, n) for n in (1, 2, 3)))).otherwise(F.array().cast("array<string>"))
    pairs = F.array_compact(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), _pair))
    return F.array_distinct(F.concat(words, pairs, dots))


def _alias_key(alias: Column) -> Column:
    words = F.transform(_words(alias), _fold)
    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    return F.coalesce(_pair(first, second), first)


def _host_key(host: Column) -> Column:
    label = F.least(F.instr(host, ".") - 1, F.lit(3))
    return F.when((label > 0) & (F.length(host) > F.instr(host, ".")), F.concat(F.lit("."), F.substring(F.lower(host), F.instr(host, ".") - label, label + 2)))


def _names(brands: DataFrame) -> DataFrame:
    """brands(brand, aliases, host) -> (brand, ord, name, is_host): the names that can be found, in order, the host last."""
    of = F.transform(F.filter("aliases", lambda a: (F.length(a) >= 2) & (F.size(_words(a)) > 0)), lambda a: F.struct(a.alias("name"), F.lit(False).alias("is_host")))
    host = F.when(F.instr("host", ".") > 1, F.struct(F.col("host").alias("name"), F.lit(True).alias("is_host")))
    return brands.select("brand", F.posexplode(F.array_compact(F.concat(of, F.array(host)))).alias("ord", "x")).select("brand", "ord", "x.name", "x.is_host")


def candidates(answers: DataFrame, names: DataFrame, salts: int = SALTS) -> DataFrame:
    """answers(no, text), names(name, is_host) -> (no, name, is_host) that share a key, once each; a superset of what stands there."""
    worded = answers.select("no", "text", F.transform(_words(F.col("text")), _fold).alias("words"))
    seen = worded.select("no", F.explode(answer_keys(F.col("text"), F.col("words"))).alias("key"), F.pmod(F.xxhash64("no"), F.lit(salts)).cast("int").alias("salt"))
    # the names are few beside the answers' words, so each key is there for all tasks that its answers are dealt out to
    key = F.when(F.col("is_host"), _host_key(F.col("name"))).otherwise(_alias_key(F.col("name")))
    index = names.select("name", "is_host", key.alias("key")).where("key IS NOT NULL").distinct()
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return seen.join(index, ["key", "salt"]).select("no", "name", "is_host")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(answers: DataFrame) -> DataFrame:
    """The answers that were given, each with a number of its own, which stays as it is written."""
    return _kept(answers.where(F.col("text").isNotNull()).withColumn("no", F.monotonically_increasing_id()), "answers")


def _hits(answers: DataFrame, names: DataFrame) -> DataFrame:
    """answers(no, text) x names(name, is_host) -> (no, name, is_host, position) of the names that stand in an answer."""
    met = candidates(answers, names).join(answers.select("no", "text"), "no")
    alias = F.when(~F.col("is_host"), F.col("name"))
    met = met.select(F.col("no").alias("id"), "text", F.struct("name", "is_host").alias("brand"), F.array_compact(F.array(alias)).alias("aliases"), F.when(F.col("is_host"), F.col("name")).alias("host"))
    return M.places(met, "(?iU)").select(F.col("id").alias("no"), "brand.name", "brand.is_host", F.when(F.col("brand.is_host"), F.col("h_")).otherwise(F.col("at_")).alias("position"))


def _earlier(names: DataFrame) -> DataFrame:
    """names(brand, ord, key) -> (brand, key, earlier): each of a brand's names once, with those that come before it."""
    keys = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"]))
    own = names.groupBy("brand").agg(keys.alias("keys"))
    return own.select("brand", "keys", F.posexplode("keys").alias("i", "key")).select("brand", "key", F.slice("keys", F.lit(1), F.col("i")).alias("earlier"))


def _overruled(seen: DataFrame, each: DataFrame) -> DataFrame:
    """seen(no, key), each(brand, key, earlier) -> (no, key, overruled): the names that stand in an answer beside key and come before it in some brand.

    Two names meet once, whatever the number of their brands, and in the answers of the rarer one.
    """
    often = seen.groupBy("key").agg(F.count("*").alias("n"))
    pairs = each.select("key", F.explode("earlier").alias("before")).distinct()
    pairs = pairs.join(often, "key").join(often.select(F.col("key").alias("before"), F.col("n").alias("n_before")), "before")
    rarer, other = (F.when(F.col("n") <= F.col("n_before"), x).otherwise(y) for x, y in ((F.col("key"), F.col("before")), (F.col("before"), F.col("key"))))
    met = pairs.select("key", "before", rarer.alias("rarer"), other.alias("other")).join(seen.select("no", F.col("key").alias("rarer")), "rarer")
    met = met.join(seen.select("no", F.col("key").alias("other")), ["no", "other"], "left_semi")
    return met.groupBy("no", "key").agg(F.collect_list("before").alias("overruled"))


def mentions(answers: DataFrame, brands: DataFrame, one_line: bool = False) -> DataFrame:
    """answers(id, text) x brands(brand, aliases, host) -> (id, brand, matched, position, context) of the answers that name a brand.

    The first alias in order that stands in the text as whole words, in either case, with the sentence around
    it; failing all, the host's address with what surrounds it. Aliases of one character, and such as have no letter or
    digit, name nothing, and so does a host without a dot. position counts from 0. brand identifies a row of brands;
    null texts name nothing. Rows of answers that share an id are searched each by its own text. With `one_line`, white space
    within a context is one space.

    The result has a row for each brand and answer that name each other, so it is made by the last join and never
    shuffled, and neither are the contexts: the names found in an answer are brought to it, and brands are sent to all
    tasks, BRANDS at a time.
    """
    known, names = _numbered(answers.select("id", "text")), _names(brands)
    keys = _kept(names.select("name", "is_host").distinct().withColumn("key", F.monotonically_increasing_id()), "names")
    hits = _kept(_hits(known, names).join(keys, ["name", "is_host"]).select("no", "key", "position"), "mentions")
    each = _kept(_earlier(names.join(keys, ["name", "is_host"]).select("brand", "ord", "key")), "earlier")
    found = hits.join(_overruled(hits.select("no", "key"), each), ["no", "key"], "left").join(keys, "key")
    # few bytes make many rows here, so the number of tasks does not follow the bytes
    tasks = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(tasks, "no").join(known.repartition(tasks, "no"), "no")
    at = lambda is_host: F.when(F.col("is_host") == is_host, F.col("position")).otherwise(-1)
    found = found.select("id", "key", "overruled", "text", F.col("name").alias("host"), F.col("name").alias("a_"), at(False).alias("at_"), at(True).alias("h_"))
    found = M.contexts(found, "id", "key", "overruled")
    if one_line:
        found = found.withColumn("context", F.regexp_replace("context", r"\s+", " "))
    # made by a generator, a context is made before the join, not for each of its rows
    found = found.select("id", "key", "overruled", F.inline(F.array(F.struct("matched", "position", "context"))))
    slices = -(-each.agg(F.count_distinct("brand")).first()[0] // BRANDS)
    sliced = [each.where(F.pmod(F.xxhash64("brand"), F.lit(slices)) == i) for i in range(slices)] or [each]
    both = functools.reduce(DataFrame.unionAll, [found.join(F.broadcast(e), "key") for e in sliced])
    return both.where("overruled IS NULL OR NOT arrays_overlap(earlier, overruled)").select("id", "brand", "matched", "position", "context")


def recognised(answer: Column) -> Column:
    """Whether an answer describes what it was asked about, and does not say that it knows nothing of it."""
    return ~answer.rlike(DISCLAIMS)


def visibility(answers: DataFrame, brands: DataFrame, ranks: bool = True) -> DataFrame:
    """answers(id, text, asked) x brands -> (brand, asked, mentioned, rate, best_rank), for every brand.

    asked counts the answers that were given; one that was not says nothing. best_rank is the best place among an answer's
    recommendations, and only there if `ranks` are asked for.

    The answers that have a name are a bitmap, and a brand's are the union of its names': no row is made for a brand and an answer.
    """
    given = answers.where("asked AND text IS NOT NULL")
    known, names = _numbered(given.select("id", "text")), _names(brands)
    bits = _hits(known, names).groupBy("name", "is_host", F.bitmap_bucket_number("no").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits"))
    each = names.join(bits, ["name", "is_host"]).groupBy("brand", "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    counts = each.groupBy("brand").agg(F.sum("n").alias("mentioned"))
    total = given.agg(F.count("*").alias("asked"))  # one row
    out = brands.select("brand").distinct().join(counts, "brand", "left").join(F.broadcast(total))
    n = F.coalesce("mentioned", F.lit(0).cast("long"))
    out = out.select("brand", "asked", n.alias("mentioned"), F.round(F.try_divide(n, F.col("asked")), 3).alias("rate"))
    if not ranks:
        return out
    # only answers that recommend several things rank them
    listed = known.select(F.col("no").alias("id"), "text", M.ranked_items(F.col("text")).alias("items")).where(F.size("items") > 0)
    ranked = mentions(listed.select("id", "text"), brands).join(listed, "id").groupBy("brand").agg(F.min(M.rank_of(F.col("items"), F.col("matched"))).alias("best_rank"))
    return out.join(ranked, "brand", "left").select("brand", "asked", "mentioned", "rate", "best_rank")
