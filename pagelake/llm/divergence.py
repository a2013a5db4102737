"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

Terms are counted by (lang, source, term) with map-side aggregation, then pivoted into one wide vector
a term: an array with a place for each source of the language, by number. JVM higher-order functions
turn a vector into smoothed shares and into the contributions of the pairs of sources; these are summed
by map-side aggregation, so that a shuffle carries a row for each pair and task at most.

All arithmetic is on integers: shares are parts of SCALE, rounded down, from decimals where a long
would not hold the product.

Sizes: a vector has as many places as its language has sources, and so has the list of a language's
sources; the result itself has a row for each ordered pair of them. No other list grows with a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import scratch

#: Runs of ASCII letters and of characters beyond ASCII; upper case is lowered before.
TERM_RX = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A language keeps the terms in so many of its documents.
LEAST_DOCS = 30
SCALE, PRIOR, TOP = 1_000_000_000, 5, 50


def lower_ascii(text: Column) -> Column:
    """Only A-Z lower-cased; a text that is all ASCII takes the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_docs): occurrences and documents of each term of a group.

    Each occurrence and each document of a term is a row of its own on the way to the map-side
    aggregation, so nothing is sorted or gathered by document.
    """
    found = _read(docs).select("lang", "source", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM_RX), F.lit(0)).alias("terms"))
    # the places behind a document's occurrences are those of its distinct terms
    rows = found.select("lang", "source", F.size("terms").alias("k"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    d = (F.col("at") >= F.col("k")).cast("int")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - d).alias("n"), F.sum(d).alias("in_docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), by decimals without a fraction."""
    upper = (count + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", upper, (total + PRIOR * terms).cast("decimal(19,0)"))


def vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(langs, terms), both as scratch tables.

    langs(lang, sources, totals, n_lang, v): the sources of a language in order, their counts over the kept
    terms, the sum of those and the number of kept terms. terms(lang, term, counts): a kept term's
    counts by the number of the source, and so in the order of sources.
    """
    groups = _read(docs.select("lang", "source", F.lit("").alias("text"))).groupBy("lang", "source").agg(F.lit(1).alias("one"))
    listed = scratch(groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")), "sources")
    numbered = listed.select("lang", F.posexplode("sources").alias("at", "source"))
    counts = term_counts(docs).join(numbered, ["lang", "source"])
    # the places of a term are gathered as (number, count), at most one a source
    wide = counts.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("own"), F.sum("in_docs").alias("in_docs")).where(F.col("in_docs") >= least_docs)
    terms = wide.join(listed, "lang").select("lang", "term", F.transform(F.sequence(F.lit(0), F.size("sources") - 1), lambda i: F.coalesce(F.try_element_at("own", i), F.lit(0).cast("long"))).alias("counts"))
    terms = scratch(terms, "vectors")
    totals = terms.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    rows = totals.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("totals"))
    zero = F.transform("sources", lambda _: F.lit(0).cast("long"))
    langs = (
        listed.join(rows, "lang", "left").join(kept, "lang", "left")
        .select("lang", "sources", F.coalesce("totals", zero).alias("totals"), F.coalesce("v", F.lit(0).cast("long")).alias("v"))
        .withColumn("n_lang", F.aggregate("totals", F.lit(0).cast("long"), lambda a, b: a + b))
    )
    return scratch(langs, "langs"), terms


def shares(langs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, term, counts, p, q): the shares of a term by source, and in its language."""
    both = terms.join(langs.select("lang", "totals", "n_lang", "v"), "lang")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    return both.select(
        "lang", "term", "counts",
        F.transform("counts", lambda n, i: _share(n, F.get("totals", i), F.col("v"))).alias("p"),
        _share(total, F.col("n_lang"), F.col("v")).alias("q"),
    )


def pair_distances(shared: DataFrame) -> DataFrame:
    """(lang, i, j, value): the sum of |p_i - p_j| over the terms, for i < j.

    Each place of a vector emits its differences to the later places, so a row holds one vector at most.
    """
    rows = shared.select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    apart = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.get("p", F.col("i"))))
    return rows.select("lang", "i", F.posexplode(apart).alias("k", "f")).groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum("f").alias("value"))


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Ranks by group; where `most` are asked for, each task hands on that many of a group at most."""
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rows = rows.withColumn("rank", F.row_number().over(by))
    return rows if most is None else rows.where(F.col("rank") <= most)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """docs(lang, source, text, ...) -> (lang, source, part, item, value, rank).

    Part `pair`: for each occurring (lang, source) the distance to each other source of the language,
    the sum over the language's kept terms of the difference of their shares. Part `term`: the `top`
    kept terms that the group uses more than its language does, by that difference.
    Null lang, source and text are ''. Groups without terms, and languages without kept terms, have their
    pairs (value 0 without kept terms) and no terms; a language's only source has no pairs. Ranks are from 1, values
    descending, then items in UTF-8 order. Repeated rows count as often as they are there.
    """
    langs, terms = vectors(docs, least_docs)
    shared = scratch(shares(langs, terms), "shares")
    summed = scratch(pair_distances(shared), "pairs")
    every = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source"))
    every = every.select("lang", "source", "i", F.posexplode("sources").alias("j", "item")).where("i <> j")
    both = every.join(summed, (every.lang == summed.lang) & (F.least(every.i, every.j) == summed.i) & (F.greatest(every.i, every.j) == summed.j), "left")
    pairs = both.select(every.lang, "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    above = F.filter(
        F.transform("p", lambda p, i: F.struct(i.alias("i"), (p - F.col("q")).alias("value"), F.get("counts", i).alias("n"))),
        lambda x: (x["value"] > 0) & (x["n"] > 0),
    )
    over = shared.select("lang", F.col("term").alias("item"), F.inline(above)).drop("n").withColumnRenamed("lang", "of")
    ranked = _ranked(over.select("of", "item", "value", F.col("i").cast("string").alias("source")).withColumnRenamed("of", "lang"), top)
    named = langs.select("lang", F.posexplode("sources").alias("i", "name"))
    best = ranked.withColumn("i", F.col("source").cast("int")).drop("source").join(named, ["lang", "i"]).select("lang", F.col("name").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return _ranked(pairs).select("lang", "source", "part", "item", "value", "rank").unionByName(best)


def audit_sql(docs: str = "documents", least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The same result for DuckDB, by a row for each group and kept term."""
    share = f"CAST(1 + (CAST({SCALE} AS HUGEINT) * (n + {PRIOR})) // (total + {PRIOR} * v) AS BIGINT)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM {docs}),
    t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM_RX}')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
    l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
    q AS (SELECT lang, term, {share} AS q FROM kept JOIN l USING (lang)),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL),
    p AS (SELECT f.lang, f.source, f.term, f.n, {share} AS p FROM f JOIN s USING (lang, source) JOIN (SELECT lang, v FROM l) USING (lang)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
    terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
    u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u
    QUALIFY part = 'pair' OR rank <= {top}
    """
