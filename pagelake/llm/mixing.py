"""Mixing sources to target weights by entropy balancing.

Each document has a size in words, each source a target of words. The document rates closest to 1 in
relative entropy (words as base measure) that meet the targets are exponential tilts exp(lambda of
the source); lambda solves the convex dual, here by Newton steps whose gradient and Hessian are
distributed aggregates over a (source, size) histogram. Rates are then rounded into copies: whole
copies for the integer part, and for the rest one more copy of those documents that come first in a
fixed pseudo-random order, until the source's words are reached; the last one is cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD_RX, free, scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_RATE = 2
#: Rows of one source that one task sums up in order.
BUCKET_ROWS = 20_000
TOLERANCE = 1e-12


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_RX)), F.lit(0)).cast("long")


def targets(hist: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_RATE) -> DataFrame:
    """hist(source, size, n) -> (source, n_docs, source_size, target).

    Sources in code point order, null last, weigh `weights` in turn. A target stops at `most` times
    the source's size; the excess goes to the others by weight until none is above. One row a
    source: each round is an aggregate over that table.
    """
    per = hist.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # rows: sources, not documents
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int"))
    per = scratch(per.withColumn("weight", weight.cast("long")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most
    capped, words, left, n = F.lit(False), 0, None, -1
    while True:
        # a share is (words left) * weight / (weights left): the same three numbers in any order of rows
        got = per.select(capped.alias("c"), limit.alias("m"), "weight").agg(
            F.count_if("c").alias("n"), F.coalesce(F.sum(F.when(F.col("c"), F.col("m"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(~F.col("c"), F.col("weight"))), F.lit(0)).alias("left")
        ).first()
        if got["n"] == n or not got["left"]:
            break
        n, words, left = got["n"], got["words"], got["left"]
        capped = (F.lit(total * share - words) * F.col("weight") / F.lit(float(left))) > limit
    target = F.when(capped, limit.cast("double")).otherwise(F.lit(total * share - words) * F.col("weight") / F.lit(float(left or 1)))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def balance(hist: DataFrame, goal: DataFrame, steps: int = 60) -> DataFrame:
    """(source, rate): rate = exp(lambda) with sum(n * size * rate) = target, by Newton on the dual."""
    lam = goal.select("source", "target", F.lit(0.0).alias("lam"))
    for step in range(steps):
        at = hist.join(lam, hist["source"].eqNullSafe(lam["source"])).select(lam["source"], "target", "lam", (F.col("n") * F.col("size") * F.exp("lam")).alias("w"))
        # gradient and Hessian of sum(w) - lambda * target; for an indicator both hold sum(w)
        new = at.groupBy("source", "target", "lam").agg(F.sum("w").alias("h")).select(
            "source", "target", (F.abs(F.col("h") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))).alias("off"),
            F.when((F.col("h") > 0) & (F.col("target") > 0), F.col("lam") - F.greatest(F.least((F.col("h") - F.col("target")) / F.col("h"), F.lit(4.0)), F.lit(-4.0))).otherwise(F.lit(-math.inf)).alias("lam"),
        )
        new = scratch(new, f"newton{step}")
        lam = new.select("source", "target", "lam")
        if (new.where(F.col("lam") > -math.inf).agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return lam.select("source", F.exp("lam").alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_RATE) -> DataFrame:
    """docs(doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, taken).

    One row for each row of docs. A null text has size 0 and is never taken; null is a source of
    its own. Repeated rows are separate documents. The order that decides who gets a further copy
    depends on doc_id alone, so reruns agree; equal ids come in order of size, then of a hash of the text.
    """
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken")
    return _mixed(docs, weights, share, most).select("doc_id", "source", "size", "source_size", "target", taken)


def _order(doc_id: Column) -> Column:
    return F.md5(doc_id.cast("string").cast("binary"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(doc_id, source, size, h, key, source_size, target, whole, more): whole copies, and words of one copy more."""
    each = scratch(docs.select("doc_id", "source", sizes(docs).alias("size"), F.xxhash64("text").alias("h")), "sizes")
    hist = scratch(each.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    goal = targets(hist, weights, share, most)
    rate = balance(hist, goal)
    goal = goal.join(rate.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = goal.withColumn("whole", F.floor(F.least(F.col("rate"), F.lit(float(most)))).cast("long"))
    goal = scratch(goal.withColumn("further", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), "goal")

    order = _order(F.col("doc_id"))
    head = F.conv(F.substring(F.coalesce(order, F.lit("0")), 1, 8), 16, 10).cast("double") / 2.0**32
    # rows without an id come first; they are dealt out by their size, which is their order
    lost = each.where("doc_id IS NULL")
    many = math.ceil(lost.count() / BUCKET_ROWS)
    cuts = sorted(set(lost.approxQuantile("size", [i / many for i in range(1, many)], 0.001))) if many > 1 else []
    rank = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("size"))) if cuts else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), rank - len(cuts) - 1).otherwise(F.floor(head * F.ceil(F.col("n_docs") / BUCKET_ROWS))).cast("int")
    df = each.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("key", order).withColumn("part", part)
    parts = df.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    df = df.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    own = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0))
    more = F.greatest(F.least(F.col("further") - before, F.col("size")), F.lit(0))
    return df.select("doc_id", "source", "size", "h", "key", "source_size", "target", "whole", more.cast("long").alias("more"))


def mix_sql(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_RATE, docs: str = "documents") -> str:
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM {docs}),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER w AS k,
    CAST(coalesce(sum({most} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words,
    CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w,
    (SELECT CAST(sum(source_size) AS BIGINT) FROM s) AS total
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT min(k) AS k FROM o WHERE (total * {share}::DOUBLE - words) * weight / left_w::DOUBLE <= {most} * source_size),
g AS (
  SELECT o.source, o.source_size, CASE WHEN o.k < f.k OR f.k IS NULL THEN CAST({most} * o.source_size AS DOUBLE)
    ELSE (o.total * {share}::DOUBLE - e.words) * o.weight / e.left_w::DOUBLE END AS target
  FROM o, f LEFT JOIN o AS e ON e.k = f.k),
c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(least(goal // greatest(source_size, 1), {most}), 0) * size
    + greatest(least(goal - least(goal // greatest(source_size, 1), {most}) * source_size - before, size), 0) AS BIGINT) AS taken
FROM c"""


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_RATE) -> DataFrame:
    """The mix as a row a source: (source, whole, last, ties, words).

    In the fixed order of a source all documents before `last` (its key, doc_id, size and hash) get one copy
    more than `whole`, those after it do not; the `ties` rows that are `last` share `words` of one.
    """
    rows = scratch(_mixed(docs, weights, share, most).select("source", "whole", "more", F.struct("key", "doc_id", "size", "h").alias("place")), "places")
    per = rows.groupBy("source").agg(F.first("whole").alias("whole"), F.max(F.when(F.col("more") > 0, F.col("place"))).alias("last"))
    per = scratch(per, "lasts")
    at = rows.join(per.select(F.col("source").alias("s"), "last"), F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("last")))
    tied = at.groupBy("s").agg(F.count("*").alias("ties"), F.sum("more").alias("words"))
    return per.join(tied, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "whole", "last", F.coalesce("ties", F.lit(0)).alias("ties"), F.coalesce("words", F.lit(0)).alias("words"))


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents as the mix takes them: whole copies repeated, the last one cut after its words.

    `plan` is mix_plan(docs). What a document gets follows from its place in its source's order, so no
    text is moved; only rows that are repeated just at a source's last place are numbered.
    """
    source, whole, last, ties, words, size, copies, rest, tie, copy = free(docs, "of_source", "whole_copies", "last_place", "tied_rows", "tied_words", "words_here", "copies_here", "rest_words", "tie_number", "copy_number")
    plan = plan.toDF(source, whole, last, ties, words)
    df = docs.where(F.col("text").rlike(WORD_RX)).join(plan, F.col("source").eqNullSafe(F.col(source)))
    end = F.col(last)
    near = F.coalesce(_order(F.col("doc_id")).eqNullSafe(end["key"]) & F.col("doc_id").eqNullSafe(end["doc_id"]), F.lit(False)) & end.isNotNull()
    df = df.withColumn(size, F.when(near, sizes(docs)))  # only asked for at the last place
    own = F.struct(_order(F.col("doc_id")).alias("key"), F.col("doc_id").alias("doc_id"))
    upto = F.struct(end["key"].alias("key"), end["doc_id"].alias("doc_id"))
    exact, before = F.struct(F.col(size).alias("size"), F.xxhash64("text").alias("h")), F.struct(end["size"].alias("size"), end["h"].alias("h"))
    more = F.when(end.isNull(), 0).when(near, F.when(exact < before, 1).otherwise(0)).when(own < upto, 1).otherwise(0)
    tied = near & (exact == before)
    df = df.withColumn(copies, (F.col(whole) + more).cast("int")).withColumn(rest, F.when(tied & (F.col(ties) == 1), F.col(words)).when(tied, F.lit(-1)).otherwise(0))
    if not plan.where(F.col(ties) > 1).isEmpty():
        numbered = df.where(F.col(rest) < 0).withColumn(tie, F.row_number().over(Window.partitionBy(source).orderBy("doc_id")) - 1)
        share = F.greatest(F.least(F.col(words) - F.col(tie) * F.col(size), F.col(size)), F.lit(0))
        df = df.where(F.col(rest) >= 0).unionAll(numbered.withColumn(rest, share).drop(tie))
    some = (F.col(rest) > 0).cast("int")
    df = df.where(F.col(copies) + some > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies) + some)))
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD_RX), F.lit(0))
    cut = F.when((F.col(copy) <= F.col(copies)) | (F.col(rest) == F.col(size)), F.col("text")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.col(rest).cast("int")), ""))
    out = [cut.alias("text") if c == "text" else F.length(cut).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return df.select(*out)
