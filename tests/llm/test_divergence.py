"""Source divergence audit: against SQL on odd rows, and against a brute-force version."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelake.llm import divergence

from ..oracle import SF
from ..oracle import rows as normal


def got(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def brute(docs, least, top=50):
    """docs: [(lang, source, text)] -> the rows of audit(), in plain loops."""
    docs = [tuple(x or "" for x in d) for d in docs]
    used, in_docs = defaultdict(Counter), Counter()
    for lang, source, text in docs:
        terms = re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        used[lang, source].update(terms)
        in_docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang})

        def shares(counts):
            total = sum(counts[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}  # noqa: B023

        p = {s: shares(used[lang, s]) for s in sources}
        q = shares(sum((used[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if used[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i) for part, rows in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(rows, 1)]
    return normal(["lang", "source", "part", "item", "value", "rank"], out)


ROWS = [
    ("en", "a", "The cat the CAT sat"), ("en", "a", "the dog"), ("en", "b", "a cat, a dog; the mouse"), ("en", "b", None), ("en", None, "the the the"), (None, "a", "cat"), (None, None, None), ("", "a", "cat dog"),
    ("de", "only", "Straße straSSE STRASSE ÄÖ äö"), ("fr", "x", ""), ("fr", "y", "123 !?"), ("en", "\U0001f600", "cat 日本 cat"), ("en", "￿", "日本 dog"), ("en", "a", "the dog"), ("en", "long", "zz cat " * 30000), ("en", "A", "x1y2z the"),
]


@pytest.mark.parametrize("least,top", [(1, 50), (2, 2), (3, 50), (99, 50)])
def test_odd_rows(spark, least, top):
    """Null, empty and long texts, null and empty groups, ties, repeated rows, languages of one source or without kept terms, clashing columns."""
    docs = spark.createDataFrame([(*r, i, "t", [1]) for i, r in enumerate(ROWS)], "lang string, source string, text string, n int, term string, counts array<int>").repartition(3)
    assert got(divergence.audit(docs, least, top)) == brute(ROWS, least, top)


def test_sql_of_odd_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", ROWS)
    res = con.execute(divergence.audit_sql(least_docs=2, top=2))
    assert normal([c[0] for c in res.description], res.fetchall()) == brute(ROWS, 2, 2)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert got(divergence.audit(docs, 3)) == brute(rows, 3)


def test_counts_beyond_a_long_product(spark):
    """A count times the scale that a long would not hold."""
    n, total, v = 20_000_000_000, 30_000_000_000, 2
    df = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(v)).alias("p"))
    assert df.first().p == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_occurrences_are_counted_without_a_structure_each(spark):
    """Occurrences and documents by the place of a term alone; texts without terms give no rows."""
    docs = spark.createDataFrame([(0, "A b a", "en", "x"), (1, "a", "en", "x"), (2, "", "en", "x"), (3, None, None, None), (4, "b b", "en", "y")], "doc_id long, text string, lang string, source string")
    got = divergence.term_counts(docs)
    assert {(r.lang, r.source, r.term): (r.n, r.in_docs) for r in got.collect()} == {("en", "x", "a"): (3, 2), ("en", "x", "b"): (1, 1), ("en", "y", "b"): (2, 1)}
    assert "struct(" not in got._jdf.queryExecution().optimizedPlan().toString()
