"""Text measures over documents, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.functions import excerpts as X
from pagelake.functions import text as T
from pagelake.functions.constants import CALLS, FIGURE_KINDS, FILLER, HEDGES, INVISIBLE, NOT_CHARTABLE, STATISTIC_BODY, WS
from pagelake.operators import text_difference as D

from .fixtures import literal


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(D.runs(F.col("text")))).cast("long").alias("shingles"))


def shingle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it: the share of shingles that only it has."""
    d = _t(spark, sf_dir, "documents").select("doc_id", T.shingles(F.col("text")).alias("r"))
    a = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("r").alias("a"))
    share = F.round(F.size(F.array_except("r", "a")) / F.greatest(F.size("r"), F.lit(1)), 3)
    return d.join(a, "doc_id").select("doc_id", share.alias("only_share"))


def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.readability(F.col("text")).alias("r")).select("doc_id", "r.*")


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", T.phrase_hits(t, HEDGES).alias("hedges"), T.phrase_hits(t, FILLER).alias("filler"), T.phrase_total(t, CALLS).alias("calls"))


def invisible_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.invisible_count(F.col("text")).alias("invisible"), (T.invisible_count(F.col("text")) >= 20).alias("flagged"))


def dup_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same collapsed text; ids are counted, the least stands for them."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse(F.col("text")).cast("binary"), 256).alias("body_hash"), F.col("text"))
    return d.where(F.trim("text") != "").groupBy("body_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_ORDER_TEXT = "concat('Order ', o_orderkey, ' rose ', o_orderkey % 97, '% in ', year(o_orderdate), ' to $', cast(floor(o_totalprice) as bigint), ' within ', o_orderkey % 31 + 2, ' days, about ', o_orderkey % 5 + 2, 'x of ', o_custkey % 9 + 1, ' million')"


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER_TEXT).alias("text"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(spark, sf_dir).select("o_orderkey", F.size(T.statistics(F.col("text"))).cast("long").alias("statistics"), F.array_join(T.statistics(F.col("text")), "|").alias("found"))


def figure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _figures(spark, sf_dir).select(F.explode(T.statistics(F.col("text"))).alias("token"))
    kind = T.figure_kind(F.col("token"))
    return tokens.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("chartable", ~F.col("kind").isin(*NOT_CHARTABLE))


def front_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(w):
        cut = F.greatest(F.lit(1), F.floor(F.size(w) * 3 / 10).cast("int"))
        head = F.size(T.statistics(F.array_join(F.slice(w, 1, cut), " "))).cast("long")
        tail = F.size(T.statistics(F.array_join(F.slice(w, cut + 1, 1000000000), " "))).cast("long")
        return F.struct(head.alias("head"), tail.alias("tail"))

    return _figures(spark, sf_dir).select("o_orderkey", T.bind(T.words(F.col("text")), of).alias("x")).select("o_orderkey", "x.head", "x.tail")


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("text", r"[\p{P}\p{S}]", " ")
    return _t(spark, sf_dir, "documents").select("doc_id", T.word_count(bare).alias("content_words"))


def keyword_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term of four letters or more that a document repeats most, where it is over 3.5 % of its words."""
    terms = F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    d = _t(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), terms.alias("terms")).where("words >= 200")

    def often(a: Column) -> Column:
        """Terms that fill ten places of the sorted list: the same stands nine places further on."""
        ten = F.filter(F.arrays_zip(a.alias("x"), F.slice(a, F.lit(10), F.size(a)).alias("y")), lambda z: z["x"] == z["y"])
        return F.transform(F.array_distinct(F.transform(ten, lambda z: z["x"])), lambda t: F.struct((F.size(a) - F.size(F.array_remove(a, t))).cast("long").alias("n"), t.alias("term")))

    best = F.array_max(F.filter(T.bind(F.col("terms"), often), lambda x: x["n"] / F.col("words") > 0.035))  # row by row: nothing is shuffled
    return d.select("doc_id", "words", best.alias("b")).where("b IS NOT NULL").select("doc_id", "b.term", F.col("b.n").alias("n"), F.round(F.col("b.n") / F.col("words"), 4).alias("density"))


def mention_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a conversation's answers mention the word 'the', null where none was asked."""
    c = _t(spark, sf_dir, "conversations")
    said = F.col("text").rlike(r"(?i)\bthe\b")
    asked = F.count_if(F.col("role") == "assistant")
    return c.groupBy("conv_id").agg(asked.alias("asked"), F.count_if((F.col("role") == "assistant") & said).alias("mentioned")).withColumn("rate", F.round(F.try_divide("mentioned", "asked"), 3))


def brand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First mention of a word in an answer, by word boundary: 0-based place and its share of the text."""
    c = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    at = F.regexp_instr("text", F.lit(r"(?i)\bthat\b")) - 1
    return c.where(F.col("text").rlike(r"(?i)\bthat\b")).select("conv_id", "turn", at.cast("long").alias("place"), F.round(at / F.greatest(F.length("text"), F.lit(1)), 3).alias("prominence"))


def interest_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events by type: means of the earlier and later half, rising or falling beyond 15 %; null under four days."""
    e = _t(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("views"))
    w = Window.partitionBy("event_type").orderBy("day")
    e = e.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("event_type")))
    half = F.floor(F.col("n") / 2)
    a = e.groupBy("event_type", "n").agg(F.avg(F.when(F.col("i") <= half, F.col("views"))).alias("first"), F.avg(F.when(F.col("i") > half, F.col("views"))).alias("second"), F.floor(F.avg("views")).cast("long").alias("average"))
    change = (F.col("second") - F.col("first")) / F.col("first")
    trend = F.when(F.col("n") < 4, None).when(change > 0.15, "rising").when(change < -0.15, "falling").otherwise("steady")
    return a.select("event_type", F.col("n").alias("days"), "average", F.round(change, 3).alias("change"), trend.alias("trend"))


#: The window of the excerpts over documents: smaller than usual, so that budgets run out.
_MARGIN, _BUDGET = 60, 900


def figure_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts around the figures of all documents; every other one states a figure after each sentence, some one at each word."""
    n = F.col("doc_id") % 4
    text = F.when(n == 0, F.replace("text", F.lit(". "), F.lit(". 43% of "))).when(n == 2, F.replace("text", F.lit(" "), F.lit(" $5, "))).otherwise(F.col("text"))
    d = _t(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return d.select("doc_id", X.figure_excerpt(F.col("text"), _MARGIN, _BUDGET).alias("x")).select("doc_id", "x.*")


def minor_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in millionths, rounded down."""
    p = F.col("o_totalprice").cast("decimal(18,2)")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.floor(p * 1000000).cast("long").alias("minor"))


_W = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '')"
_SH = (
    f"CASE WHEN len(w) >= 8 THEN list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) "
    "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
)
_STAT = "'(?i)(^|[^\\w.])" + STATISTIC_BODY.replace("'", "''").replace("(?:", "(", 1) + "'"


def _found(text: str) -> str:
    return f"regexp_extract_all({text}, {_STAT}, 2)"


def _in(phrases: tuple[str, ...]) -> str:
    return "[" + ", ".join(literal(p) for p in phrases) + "]"


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(trim(token), {literal(rx)}) THEN {literal(k)}" for k, rx in FIGURE_KINDS) + " ELSE 'other' END"
_SYL = (
    "list_sum(list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: CASE WHEN x = '' THEN 0 ELSE greatest(1, "
    "len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN suffix(x, 'e') AND NOT regexp_matches(x, '(le|ee|ye)$') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END))"
)
_ODD = "(length(text) - length(translate(text, " + literal("".join(INVISIBLE)) + ", '')))"

QUERIES = {f.__name__: f for f in (word_count, shingles, shingle_diff, text_digest, readability, phrase_hits, invisible_chars, dup_bodies, statistics, figure_kinds, front_loading, content_words, keyword_stuffing, mention_rate, brand_mentions, interest_trend, figure_excerpt, minor_units)}

ORACLE_SQL = {
    "word_count": f"SELECT doc_id, CAST(len({_W}) AS BIGINT) AS words FROM documents",
    "shingles": f"WITH t AS (SELECT doc_id, {_W} AS w FROM documents) SELECT doc_id, CAST(len({_SH}) AS BIGINT) AS shingles FROM t",
    "shingle_diff": f"WITH t AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT doc_id, {_SH} AS s FROM t) "
    "SELECT r.doc_id, round(len(list_filter(r.s, lambda x: NOT list_contains(a.s, x)))::DOUBLE / greatest(len(r.s), 1), 3) AS only_share FROM s r JOIN s a ON r.doc_id = a.doc_id + 1",
    "text_digest": "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents",
    "readability": "WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+') AS w, list_filter(string_split(regexp_replace(text, '[.!?]+(\\s|$)', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s', ' ', 'g')) <> '') AS s FROM documents), "
    f"n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(s) AS BIGINT) AS sentences, CAST(coalesce({_SYL}, 0) AS BIGINT) AS syllables FROM t) "
    "SELECT *, CASE WHEN n_words > 0 AND sentences > 0 THEN round(n_words / sentences, 1) END AS words_per_sentence, "
    "CASE WHEN n_words > 0 AND sentences > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (n_words / sentences) - 84.6::DOUBLE * (syllables / n_words), 1) END AS flesch FROM n",
    "phrase_hits": f"SELECT doc_id, CAST(len(list_filter({_in(HEDGES)}, lambda p: contains(lower(text), p))) AS BIGINT) AS hedges, CAST(len(list_filter({_in(FILLER)}, lambda p: contains(lower(text), p))) AS BIGINT) AS filler, "
    f"CAST(list_sum(list_transform({_in(CALLS)}, lambda p: (length(text) - length(replace(lower(text), p, ''))) // length(p))) AS BIGINT) AS calls FROM documents",
    "invisible_chars": f"SELECT doc_id, CAST({_ODD} AS BIGINT) AS invisible, {_ODD} >= 20 AS flagged FROM documents",
    "dup_bodies": f"SELECT sha256(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS body_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1",
    "statistics": f"WITH t AS (SELECT o_orderkey, {_ORDER_TEXT} AS text FROM orders) SELECT o_orderkey, CAST(len({_found('text')}) AS BIGINT) AS statistics, array_to_string({_found('text')}, '|') AS found FROM t",
    "figure_kinds": f"WITH t AS (SELECT unnest({_found('text')}) AS token FROM (SELECT {_ORDER_TEXT} AS text FROM orders)) SELECT {_KIND} AS kind, count(*) AS n, {_KIND} NOT IN ('year', 'other') AS chartable FROM t GROUP BY 1, 3",
    "front_loading": f"WITH t AS (SELECT o_orderkey, {_ORDER_TEXT} AS text FROM orders), w AS (SELECT o_orderkey, {_W} AS w FROM t), c AS (SELECT *, greatest(1, len(w) * 3 // 10) AS cut FROM w) "
    f"SELECT o_orderkey, CAST(len({_found(chr(97) + 'rray_to_string(w[1:cut], chr(32))')}) AS BIGINT) AS head, CAST(len({_found(chr(97) + 'rray_to_string(w[cut+1:], chr(32))')}) AS BIGINT) AS tail FROM c",
    "content_words": f"SELECT doc_id, CAST(len({_W}) AS BIGINT) AS content_words FROM (SELECT doc_id, regexp_replace(text, '[\\p{{P}}\\p{{S}}]', ' ', 'g') AS text FROM documents)",
    "keyword_stuffing": f"WITH t AS (SELECT doc_id, len({_W}) AS words, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM documents), n AS (SELECT doc_id, words, term, count(*) AS n FROM t WHERE words >= 200 GROUP BY ALL HAVING count(*) >= 10 AND count(*) / words > 0.035), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term DESC) AS k FROM n) SELECT doc_id, term, n, round(n / words, 4) AS density FROM r WHERE k = 1",
    "mention_rate": "SELECT conv_id, count(*) FILTER (role = 'assistant') AS asked, count(*) FILTER (role = 'assistant' AND regexp_matches(text, '(?i)\\bthe\\b')) AS mentioned, round(count(*) FILTER (role = 'assistant' AND regexp_matches(text, '(?i)\\bthe\\b')) / nullif(count(*) FILTER (role = 'assistant'), 0), 3) AS rate FROM conversations GROUP BY conv_id",
    "brand_mentions": "WITH t AS (SELECT conv_id, turn, text, length(string_split_regex(text, '(?i)\\bthat\\b')[1]) AS p FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '(?i)\\bthat\\b')) SELECT conv_id, turn, CAST(p AS BIGINT) AS place, round(p / greatest(length(text), 1), 3) AS prominence FROM t",
    "interest_trend": "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS views FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d), "
    "a AS (SELECT event_type, n AS days, avg(views) FILTER (i <= n // 2) AS f, avg(views) FILTER (i > n // 2) AS s, CAST(floor(avg(views)) AS BIGINT) AS average FROM r GROUP BY ALL) "
    "SELECT event_type, days, average, round((s - f) / f, 3) AS change, CASE WHEN days < 4 THEN NULL WHEN (s - f) / f > 0.15 THEN 'rising' WHEN (s - f) / f < -0.15 THEN 'falling' ELSE 'steady' END AS trend FROM a",
    "minor_units": "SELECT o_orderkey, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 1000000) AS BIGINT) AS minor FROM orders",
}
ORACLE_SQL["figure_excerpt"] = f"""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, '. ', '. 43% of ') WHEN 2 THEN replace(text, ' ', ' $5, ') ELSE coalesce(text, '') END AS text FROM documents),
m AS (SELECT *, regexp_extract_all(text, {_STAT}, 0) AS whole, {_found('text')} AS own, string_split_regex(text, {_STAT}) AS gaps FROM d),
k AS (SELECT *, len(own) AS n, unnest(range(1, least(len(own), {X.FIGURES}) + 1)) AS i FROM m),
p AS (SELECT doc_id, text, n, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) + length(whole[i]) - length(own[i]) AS lo, length(own[i]) AS w FROM k),
s AS (SELECT doc_id, text, n, i, greatest(lo - {_MARGIN}, 0) AS lo, least(lo + w + {_MARGIN}, length(text)) AS hi FROM p),
g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM s),
h AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, any_value(text) AS text, any_value(n) AS n, min(lo) AS lo, max(hi) AS hi FROM h GROUP BY doc_id, run),
b AS (SELECT *, sum(hi - lo) OVER (PARTITION BY doc_id ORDER BY run) AS spent FROM r),
e AS (SELECT doc_id, string_agg(substr(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)), '{X.GAP}' ORDER BY run) FILTER (spent <= {_BUDGET}) AS excerpt, substr(arg_min(text, run), CAST(min(lo) + 1 AS BIGINT), {_BUDGET}) AS first, count(*) FILTER (spent <= {_BUDGET}) = count(*) AND any_value(n) <= {X.FIGURES} AS covered FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(excerpt, first, '') AS excerpt, coalesce(covered, true) AS covered FROM d LEFT JOIN e USING (doc_id)"""
