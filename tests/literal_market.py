"""Small recorded tables of keywords, demand, captures and answers, and what the operators make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.operators import market as M

from pagelake.plans.fixtures import Fixture, expected

PHRASES = Fixture("phrases", "ord int, phrase string", [
    (1, "buy crm software"), (2, "crm pricing"), (3, "best crm software"), (4, "notion vs jira"), (5, "crm login"), (6, "what is crm"), (7, "crm meaning"), (8, "best price crm"), (9, "crm tools"), (10, "crm software pricing"),
])
SUGGESTIONS = Fixture("s", "engine string, variation string, phrase string, error string", [
    ("google", "crm", "CRM  tools", None), ("ddg", "crm", "crm tools", None), ("google", "crm a", "crm app", None), ("ddg", "crm b", None, "timeout"), ("ddg", "crm c", None, "timeout"), ("google", "crm d", "other thing", None),
])
COMPONENTS = Fixture("c", "seed string, component string, score double, weight int", [
    ("a", "long_tail", 0.5, 35), ("a", "engine_agreement", 0.25, 20), ("a", "community", 1.0, 25), ("a", "interest", 0.6, 20), ("b", "long_tail", 0.5, 35), ("b", "engine_agreement", 0.25, 20), ("b", "community", None, 25), ("b", "interest", None, 20), ("c", "long_tail", None, 35),
])
MONTHS = Fixture("m", "topic string, month string, views long", [("up", f"20240{i}", v) for i, v in enumerate((10, 10, 20, 20, 21), 1)] + [("flat", f"20240{i}", 10) for i in range(1, 6)] + [("few", f"20240{i}", 10) for i in range(1, 4)] + [("down", f"20240{i}", v) for i, v in enumerate((30, 30, 10, 10), 1)])
CAPTURES = Fixture("c", "domain string, crawl string, url string, status string, mime string, unreachable boolean", [
    ("a", "2024-1", "https://a/1", "200", "text/html", False), ("a", "2024-1", "https://a/2", "404", "text/html", False), ("a", "2024-2", "https://a/1", "200", "application/pdf", False), ("b", "2024-1", None, None, None, False), ("b", "2024-2", None, None, None, True), ("c", "2024-1", None, None, None, True), ("d", "2024-1", None, None, None, False),
])
CHAIN = Fixture("a", "prompt string, position int, model string, answer string", [("p", 1, "m1", None), ("p", 2, "m2", "yes"), ("p", 3, "m3", "no"), ("q", 1, "m1", None)])
JSONS = Fixture("j", "id int, raw string", [(1, '{"a": 1}'), (2, '```json\n{"a": 2}\n```'), (3, 'Sure: {"a": 3} done'), (4, "[1, 2]"), (5, "none"), (6, "Here [1, 2] ok")])
DIGESTS = Fixture("d", "id int, json string", [(1, '{"b": 1, "a": {"ttfb_ms": 5, "x": [1, 2]}}'), (2, '{"a": {"x": [1, 2], "ttfb_ms": 9}, "b": 1, "fetched_at": "now"}'), (3, '{"a": {"x": [2, 1]}, "b": 1}')])
QUOTES = Fixture("q", "id int, source string, quote string", [(1, "It works, very well!", "it WORKS very well"), (2, "one two three", "two four"), (3, "a b c d e f g h i j k l m n", "a b c d e f g h i j k l zz yy"), (4, "x", "")])
LANGS = Fixture("l", "id int, lang string", [(1, "en"), (2, "en-US"), (3, "english"), (4, "zh-Hans"), (5, "e"), (6, "en_US"), (7, "")])
PAIRS = Fixture("p", "id int, title string, headline string", [(1, "Ten best tools for teams", "Best tools"), (2, "Cooking rice", "Rocket science basics"), (3, "Guide to green tea brewing", "Brewing green tea at home")])
HEADS = Fixture("h", "page_id int, pos int, level int", [(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 4, 2), (3, 1, 3)])
GUARD = Fixture("g", "id int, url string", [(1, "https://a.example/x"), (2, "ftp://a.example"), (3, "http://127.0.0.1/"), (4, "http://a.example:8080/"), (5, "http://10.1.2.3/"), (6, "http://localhost/"), (7, "http://192.168.1.4:80/")])


def _over(fixture: Fixture, f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(fixture.df(spark))

    return run


def kw_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(M.variations("crm"))], "ord int, variation string")


_X = lambda f, sql: f"WITH {f.cte()} {sql}"
_INTENT = "CASE WHEN regexp_matches(phrase, '(?i)\\b(buy|price|pricing|cost|cheap|discount|coupon|deal|order|subscription|trial|quote|hire|book)\\b') THEN 'transactional' WHEN regexp_matches(phrase, '(?i)\\b(best|top|review|reviews|compare|comparison|vs|versus|alternative|alternatives)\\b') THEN 'commercial' WHEN regexp_matches(phrase, '(?i)\\b(login|log in|sign in|download|app|dashboard|portal|documentation|docs|support)\\b') THEN 'navigational' ELSE 'informational' END"

QUERIES = {
    "intent": _over(PHRASES, lambda d: d.select("ord", M.intent(F.col("phrase")).alias("intent"))),
    "intent_counts": _over(PHRASES, lambda d: d.groupBy(M.intent(F.col("phrase")).alias("intent")).agg(F.count("*").alias("n"))),
    "kw_tokens": _over(PHRASES, lambda d: d.select("ord", F.array_join(M.tokens(F.col("phrase")), " ").alias("tokens"))),
    "kw_cluster": _over(PHRASES, M.cluster), "kw_variations": kw_variations,
    "kw_merge": _over(SUGGESTIONS, lambda d: M.merge_suggestions(d, "crm").withColumn("sources", F.array_join("sources", ","))), "kw_failures": _over(SUGGESTIONS, M.engine_failures),
    "demand_index": _over(COMPONENTS, M.demand_index), "interest_series": _over(MONTHS, M.interest), "corpus_presence": _over(CAPTURES, M.corpus_presence), "model_chain": _over(CHAIN, M.model_chain),
    "json_tolerant": _over(JSONS, lambda d: d.select("id", M.json_tolerant(F.col("raw")).alias("json"))),
    "stable_digest": _over(DIGESTS, lambda d: M.stable_digest(d, "json").select("id", "digest")),
    "contains_norm": _over(QUOTES, lambda d: d.select("id", T.contains_norm(F.col("source"), F.col("quote")).alias("found"))),
    "lang_valid": _over(LANGS, lambda d: d.select("id", F.col("lang").rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$").alias("valid"))),
    "schema_contradiction": _over(PAIRS, M.title_agreement), "heading_skips": _over(HEADS, M.heading_skips), "guard_static": _over(GUARD, M.guard_static),
}
ORACLE_SQL = {
    "intent": _X(PHRASES, f"SELECT ord, {_INTENT} AS intent FROM phrases"), "intent_counts": _X(PHRASES, f"SELECT {_INTENT} AS intent, count(*) AS n FROM phrases GROUP BY 1"),
    "kw_tokens": expected("ord int, tokens string", [(1, "buy crm software"), (2, "crm pricing"), (3, "crm software"), (4, "jira notion"), (5, "crm login"), (6, "crm"), (7, "crm meaning"), (8, "crm price"), (9, "crm tools"), (10, "crm pricing software")]),
    "kw_cluster": expected("ord int, phrase string, intent string, cluster int", [
        (1, "buy crm software", "transactional", 1), (2, "crm pricing", "transactional", 1), (8, "best price crm", "transactional", 8), (10, "crm software pricing", "transactional", 1), (3, "best crm software", "commercial", 3), (4, "notion vs jira", "commercial", 4),
        (5, "crm login", "navigational", 5), (6, "what is crm", "informational", 6), (7, "crm meaning", "informational", 6), (9, "crm tools", "informational", 9),
    ]),
    "kw_variations": expected("ord int, variation string", [(i, v) for i, v in enumerate(["crm", *(f"crm {c}" for c in "abcdefghijklmnopqrstuvwxyz"), *(f"{w} crm" for w in ("how", "what", "why", "when", "where", "which", "who", "can", "is", "are", "does", "do", "should", "will")), *(f"crm {p}" for p in ("for", "with", "without", "vs", "versus", "near", "like", "to", "in", "on"))])]),
    "kw_merge": expected("phrase string, sources string, seen long, intent string", [("crm tools", "ddg,google", 2, "informational"), ("crm app", "google", 1, "navigational")]), "kw_failures": _X(SUGGESTIONS, "SELECT engine, count(*) AS failures FROM s WHERE error IS NOT NULL GROUP BY engine"),
    "demand_index": _X(COMPONENTS, "SELECT seed, round(100 * sum(score * weight) / sum(weight) FILTER (score IS NOT NULL), 1) AS demand_index, round(coalesce(sum(weight) FILTER (score IS NOT NULL), 0) / 100, 2) AS confidence FROM c GROUP BY seed"),
    "interest_series": expected("topic string, months long, average long, trend string", [("up", 5, 16, "rising"), ("flat", 5, 10, "steady"), ("few", 3, 10, None), ("down", 4, 20, "falling")]),
    "corpus_presence": expected("domain string, checked long, unreachable long, present long, captures long, status_2xx long, html long, urls long, verdict string", [("a", 2, 0, 2, 3, 2, 2, 2, "present"), ("b", 2, 1, 0, 0, 0, 0, 0, "partly known"), ("c", 1, 1, 0, 0, 0, 0, 0, "not measured"), ("d", 1, 0, 0, 0, 0, 0, 0, "absent")]),
    "model_chain": _X(CHAIN, "SELECT prompt, arg_min(model, position) AS model, arg_min(answer, position) AS answer FROM a WHERE answer IS NOT NULL GROUP BY prompt"),
    "json_tolerant": expected("id int, json string", [(1, '{"a":1}'), (2, '{"a":2}'), (3, '{"a":3}'), (4, "[1,2]"), (5, None), (6, "[1,2]")]),
    "stable_digest": "SELECT CAST(id AS INTEGER) AS id, 'sha256:' || sha256(j) AS digest FROM (VALUES (1, '{\"a\":{\"x\":[1,2]},\"b\":1}'), (2, '{\"a\":{\"x\":[1,2]},\"b\":1}'), (3, '{\"a\":{\"x\":[2,1]},\"b\":1}')) AS t(id, j)",
    "contains_norm": expected("id int, found boolean", [(1, True), (2, False), (3, True), (4, False)]), "lang_valid": expected("id int, valid boolean", [(1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, False)]),
    "schema_contradiction": expected("id int, contradicts boolean", [(1, False), (2, True), (3, False)]), "heading_skips": _X(HEADS, "SELECT * FROM (SELECT page_id, lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS from_level, level AS to_level FROM h) WHERE to_level > from_level + 1"),
    "guard_static": expected("id int, allowed boolean", [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False)]),
}
