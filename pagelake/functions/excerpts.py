"""Excerpts around the figures of a text, as column expressions: places, windows, islands of windows, a budget.

At most FIGURES places count, so every array here is short; nothing is exploded and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Characters kept around a figure, in all, and figures taken at most.
MARGIN, BUDGET, FIGURES = 220, 6000, 40
#: What stands between pieces that are not next to each other.
GAP = "\n[…]\n"
_PLACES = "array<struct<lo:int,hi:int>>"


def _place(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def places(text: Column, rx: str, most: int) -> Column:
    """The first `most` matches of a pattern as (lo, hi), from 0, hi exclusive: the pieces between matches and the matches alternate."""
    found = F.slice(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), 1, most)

    def of(m: Column) -> Column:
        between = F.transform(F.slice(F.split(text, rx, most + 1), F.lit(1), F.size(m)), lambda x: F.length(x))
        each = F.arrays_zip(between.alias("gap"), F.transform(m, lambda x: F.length(x)).alias("own"))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            lo = acc["at"] + x["gap"]
            return F.struct((lo + x["own"]).alias("at"), F.concat(acc["out"], F.array(_place(lo, lo + x["own"]))).alias("out"))

        return F.when(F.size(m) > 0, F.aggregate(each, none, add, lambda acc: acc["out"])).otherwise(F.array().cast(_PLACES))

    return T.bind(found, of)


def islands(spans: Column, margin: int, length: Column) -> Column:
    """Spans in order, widened by a margin within the text; those that then touch are one."""
    def add(acc: Column, x: Column) -> Column:
        lo, hi = F.greatest(x["lo"] - margin, F.lit(0)), F.least(x["hi"] + margin, length)
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(_place(last["lo"], F.greatest(last["hi"], hi))))
        return F.when((F.size(acc) > 0) & (lo <= last["hi"]), joined).otherwise(F.concat(acc, F.array(_place(lo, hi))))

    return F.aggregate(spans, F.array().cast(_PLACES), add)


def within(spans: Column, budget: int) -> Column:
    """The first spans whose lengths add up to the budget at most; none after the first that does not fit."""
    none = F.struct(F.lit(0).alias("spent"), F.array().cast(_PLACES).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        spent = acc["spent"] + x["hi"] - x["lo"]
        return F.struct(spent.alias("spent"), F.when(spent <= budget, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, none, add, lambda acc: acc["out"])


def figure_excerpt(text: Column, margin: int = MARGIN, budget: int = BUDGET, most: int = FIGURES) -> Column:
    """struct(excerpt, covered): the text around its figures, within a budget, and whether all figures are in it.

    A single stretch that is larger than the whole budget gives its beginning. Without figures, and for a null text, the excerpt is empty and covers all.
    """
    def cut(lo: Column, n: Column) -> Column:
        return F.substring(text, lo + 1, n)

    def of(v: Column) -> Column:
        kept = within(v["runs"], budget)
        pieces = F.array_join(F.transform(kept, lambda x: cut(x["lo"], x["hi"] - x["lo"])), GAP)
        first = F.try_element_at(v["runs"], F.lit(1))
        return F.struct(
            F.when(F.size(v["runs"]) == 0, "").when(F.size(kept) == 0, cut(first["lo"], F.lit(budget))).otherwise(pieces).alias("excerpt"),
            ((F.size(kept) == F.size(v["runs"])) & (v["n"] <= most)).alias("covered"),
        )

    whole = F.coalesce(text, F.lit(""))
    text = whole
    n = F.size(T.statistics(whole))
    return T.bind(F.struct(islands(places(whole, T.STATISTIC, most), margin, F.length(whole)).alias("runs"), n.alias("n")), of)
