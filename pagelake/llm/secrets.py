"""Secret scanning through a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams (an OR of clauses, each an AND of
trigrams that any match must contain). The index posts, for the trigrams that rules ask for, the
documents that contain them; a rule's postings are intersected per clause, and only candidates are
verified with the regex itself. A rule without a mandatory trigram scans every document in full.

The index is built for the trigrams of the rules at hand, not kept for others: postings of all trigrams
of a text are several times the text, those of the rules a small part of it. A bitmap of the candidates'
ids, of bounded size, parts the documents into those that may be candidates, whose texts meet the
candidates in a join, and the others, which stay where they lie.
Everything on the executors is DataFrame functions; only the rules are analysed in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as _c
from re import _parser as _p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import marked, scratch

_MAX_SET = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` must have `least` characters, or else the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


def either_case(words: str) -> str:
    """A pattern whose ASCII letters match in either case and nothing else."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() and c.isascii() else c for c in words)


_KEYWORDS = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
#: The first three are the base kinds, in their order; the others add spans.
RULES = (
    Rule("assign", _KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", "[0-9a-f]+", 24, 0, True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
)

Clauses = frozenset[frozenset[str]]
_ALL: Clauses = frozenset({frozenset()})


def _any(a: Clauses, b: Clauses) -> Clauses:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _every(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > _MAX_SET:
        return a
    return _any(frozenset(x | y for x in a for y in b), frozenset())


def _of_strings(strings: set[str]) -> Clauses:
    out: Clauses = frozenset()
    for s in strings:
        out = _any(out, frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}))
    return out


def _chars(items: list) -> set[str] | None:
    """The lower-cased characters of a class, or None if they are too many."""
    out: set[str] = set()
    for op, x in items:
        if op is _c.LITERAL:
            out.add(chr(x).lower())
        elif op is _c.RANGE and x[1] - x[0] < 8:
            out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(seq) -> tuple[set[str] | None, Clauses]:
    """(the strings that the sequence matches, if few; what any match must contain)."""
    query, run, exact = _ALL, {""}, True

    def flush() -> None:
        nonlocal query, run
        query = _every(query, _of_strings(run))
        run = {""}

    for op, x in seq:
        strings, part = None, _ALL
        if op is _c.LITERAL:
            strings = {chr(x).lower()}
        elif op is _c.IN:
            strings = _chars(x)
        elif op is _c.SUBPATTERN:
            strings, part = _walk(x[3])
        elif op is _c.BRANCH:
            arms = [_walk(a) for a in x[1]]
            if all(s is not None for s, _ in arms):
                strings = set().union(*(s for s, _ in arms))
            else:
                part = frozenset()
                for s, q in arms:
                    part = _any(part, q if s is None else _of_strings(s))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, body = x
            s, q = _walk(body)
            if s is not None and high == 1 and low == 0:
                strings = s | {""}
            elif low > 0:
                part = q if s is None else _of_strings(s)
        elif op is _c.AT:
            continue
        if strings is not None and len(run) * len(strings) <= _MAX_SET:
            run = {a + b for a in run for b in strings}
        else:
            exact = False
            flush()
            query = _every(query, part if strings is None else _of_strings(strings))
    if exact:
        return run, _of_strings(run)
    flush()
    return None, query


def trigram_query(pattern: str) -> list[list[str]]:
    """The clauses of a rule, over lower-cased trigrams; [] if it has no mandatory trigram."""
    _, query = _walk(_p.parse(pattern))
    return [] if frozenset() in query else sorted(sorted(c) for c in query)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the asked-for trigrams over whole lower-cased texts."""
    low = F.lower(F.col("text"))
    has = F.filter(F.array(*(F.lit(t) for t in trigrams)), lambda t: F.contains(F.col("low"), t))
    return (
        docs.select("doc_id", low.alias("low")).where(F.col("low").isNotNull())
        .select("doc_id", F.explode(has).alias("trigram"))
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the indexed rules of which some clause has all its trigrams in the document."""
    spark = docs.sparkSession
    rows = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern)) for t in c]
    if not rows:
        return spark.createDataFrame([], "doc_id long, kinds array<string>")
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    index = trigram_index(docs, sorted({x[2] for x in rows}))
    # the clauses are as large as the rules, whatever the corpus
    hits = index.distinct().join(F.broadcast(clauses), "trigram").groupBy("doc_id", "kind", "clause").agg(F.count("*").alias("got"), F.first("need").alias("need"))
    return hits.where("got = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


_SPAN = "struct<start:int,at:int,end:int,kind:string,ok:boolean>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(lens: Column) -> Column:
    """The running sums of an array of ints before each element, in time n * sqrt(n): by sums of blocks."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def summed(v: Column) -> Column:
        a, width = v["a"], v["w"]
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1), lambda b: total(F.slice(a, b * width + 1, width)))
        starts = _let(blocks, lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))))
        return _let(starts, lambda s: F.transform(a, lambda _, k: F.get(s, F.floor(k / width).cast("int")) + total(F.slice(a, (F.floor(k / width) * width + 1).cast("int"), k % width))))

    return _let(F.struct(lens.alias("a"), F.greatest(F.ceil(F.sqrt(F.size(lens))), F.lit(1)).cast("int").alias("w")), summed)


def _spans(i: int, rule: Rule) -> Column:
    """Array of the rule's spans: the pieces p between matches and the matches m alternate."""
    m, p, g = F.col(f"m{i}"), F.col(f"p{i}"), F.col(f"g{i}" if rule.group else f"m{i}")
    lengths = F.struct(*(F.transform(a, lambda x: F.length(x)).alias(k) for k, a in (("m", m), ("p", F.slice(p, F.lit(1), F.size(m))), ("g", g))))

    def walked(v: Column) -> Column:
        steps = F.zip_with(v["m"], v["p"], lambda x, y: x + y)
        each = F.arrays_zip(_before(steps).alias("before"), v["m"].alias("m"), v["p"].alias("p"), v["g"].alias("g"))
        return F.transform(each, lambda x: F.struct(
            (x["before"] + x["p"]).alias("start"), F.lit(i).alias("at"), (x["before"] + x["p"] + x["m"]).alias("end"), F.lit(rule.kind).alias("kind"), (x["g"] >= rule.least).alias("ok")))

    return F.when(F.size(m) > 0, F.filter(_let(lengths, walked), lambda x: x["ok"])).otherwise(F.array()).cast(f"array<{_SPAN}>")


def _found(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """df(doc_id, text, kinds) -> the result of scan; rules without trigrams run everywhere, others where kinds names them."""
    for i, r in enumerate(rules):
        wanted = F.array_contains("kinds", r.kind) if trigram_query(r.pattern) else F.lit(True)
        # a pass that skips failing matches may only be used where a failing match hides no other
        runs = re.fullmatch(r"(\w*)\[[^\]]+\]\+", r.pattern) and r.least and not r.group
        rx = f"{r.pattern[:-1]}{{{r.least - len(re.match(r'[A-Za-z]*', r.pattern)[0])},}}" if runs else r.pattern
        df = df.withColumn(f"m{i}", F.when(wanted, F.regexp_extract_all("text", F.lit(rx), F.lit(0))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(f"p{i}", F.when(F.size(f"m{i}") > 0, F.split("text", rx, -1)))
        if r.group:
            df = df.withColumn(f"g{i}", F.when(F.size(f"m{i}") > 0, F.regexp_extract_all("text", F.lit(rx), F.lit(r.group))))
    for i, r in enumerate(rules):
        df = df.withColumn(f"s{i}", _spans(i, r))

    def listed(which: list[int]) -> Column:
        spans = F.array_sort(F.concat(*(F.col(f"s{i}") for i in which)))
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    of_base = [i for i, r in enumerate(rules) if r.base]
    return df.select(
        "doc_id",
        *(F.size(f"s{i}").cast("long").alias(f"n_{rules[i].kind}") for i in of_base),
        F.sha2(listed(of_base).cast("binary"), 256).alias("base_sha256"),
        listed(list(range(len(rules)))).alias("spans"),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_<kind> of the base kinds, base_sha256, spans).

    One row for each row of docs. Null and empty texts have no spans and the hash of an empty text.
    Spans are kind:start:end in code points, end exclusive, by start and then by the rules' order;
    matches of a kind are leftmost and do not overlap. Rows that share a doc_id share candidates,
    each is verified on its own text. A null doc_id is an id like others.
    """
    found = scratch(candidates(docs, rules).withColumnRenamed("doc_id", "cand_id"), "candidates")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = marked(base, F.col("doc_id"), found.select("cand_id"), "may")
    moved = base.where("may").drop("may").join(found, F.col("doc_id").eqNullSafe(F.col("cand_id")), "left").drop("cand_id")
    none = F.array().cast("array<string>")
    return _found(moved.withColumn("kinds", F.coalesce("kinds", none)), rules).unionAll(_found(base.where("NOT may").drop("may").withColumn("kinds", none), rules))


def scan_sql(rules: tuple[Rule, ...] = RULES, docs: str = "documents") -> str:
    """The same result for DuckDB, by the full scan of every document."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    cols, spans = [], []
    for i, r in enumerate(rules):
        rx = quoted(r.pattern)
        cols.append(f"regexp_extract_all(text, {rx}, 0) AS m{i}, string_split_regex(text, {rx}) AS p{i}" + (f", regexp_extract_all(text, {rx}, {r.group}) AS g{i}" if r.group else ""))
        start = f"coalesce(list_sum(list_transform(p{i}[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{i}[1:k-1], lambda x: length(x))), 0)"
        got = f"length({'g' if r.group else 'm'}{i}[k])"
        spans.append(
            f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: {got} >= {r.least}), "
            f"lambda k: {{'s': CAST({start} AS BIGINT), 'at': {i}, 'e': CAST({start} + length(m{i}[k]) AS BIGINT), 'kind': '{r.kind}'}}) AS s{i}"
        )
    base = [i for i, r in enumerate(rules) if r.base]

    def listed(which: list[int]) -> str:
        both = f"s{which[0]}"
        for i in which[1:]:
            both = f"list_concat({both}, s{i})"
        return f"coalesce(array_to_string(list_transform(list_sort({both}), lambda x: x.kind || ':' || x.s || ':' || x.e), ','), '')"

    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {docs}), m AS (SELECT doc_id, {', '.join(cols)} FROM t), "
        f"s AS (SELECT doc_id, {', '.join(spans)} FROM m) SELECT doc_id, "
        + ", ".join(f"CAST(len(s{i}) AS BIGINT) AS n_{rules[i].kind}" for i in base)
        + f", sha256({listed(base)}) AS base_sha256, {listed(list(range(len(rules))))} AS spans FROM s"
    )
