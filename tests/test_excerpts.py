"""Excerpts around figures: what the window has to hold."""

import re

import pytest
from pyspark.sql import functions as F

from pagelake.functions import excerpts as X
from pagelake.functions import text as T


def got(spark, text, **how):
    r = spark.createDataFrame([(text,)], "t string").select(X.figure_excerpt(F.col("t"), **how).alias("x")).first().x
    return r.excerpt, r.covered


def plain(text, margin, budget, most):
    """The same with loops."""
    spots = [m.span() for m in re.finditer(T.STATISTIC, text)]
    runs = []
    for lo, hi in spots[:most]:
        lo, hi = max(0, lo - margin), min(len(text), hi + margin)
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi))
        else:
            runs.append((lo, hi))
    kept = []
    for lo, hi in runs:
        if sum(b - a for a, b in kept) + hi - lo > budget:
            break
        kept.append((lo, hi))
    if runs and not kept:
        return text[runs[0][0] : runs[0][0] + budget], False
    return X.GAP.join(text[a:b] for a, b in kept), len(kept) == len(runs) and len(spots) <= most


def test_figures_behind_a_long_head_are_in_it(spark):
    out, covered = got(spark, "filler sentence with no numbers at all. " * 120 + "Revenue grew 47% to $3.2 million.")
    assert "47%" in out and "$3.2 million" in out and covered
    out, _ = got(spark, "x " * 3000 + "Conversion on the pricing page rose to 47% after the redesign." + " y" * 3000)
    assert "Conversion on the pricing page rose to 47%" in out


def test_more_than_fits_is_said(spark):
    text = " ".join(f"Metric {i} reached {i}% in the period under review, a notable change." for i in range(400))
    out, covered = got(spark, text)
    assert not covered and 0 < len(out) <= X.BUDGET + 64 and all(p in text for p in out.split(X.GAP))
    out, covered = got(spark, "".join(f"{i}% " for i in range(6000)), budget=100)
    assert len(out) == 100 and not covered


@pytest.mark.parametrize("text", [None, "", "prose with no numbers whatsoever", "43%", "x 5% " + "y" * 60 + " $7 z", "a" * 30 + " 43% " + "b" * 30, "été 5% 日本 2021 \U0001f600 10 km\n1,000", "5%" * 50, "1,000 " * 45, ("w " * 20 + "in 1999 ") * 30])
@pytest.mark.parametrize("how", [(3, 20, 40), (10, 200, 5), (0, 1, 1), (220, 6000, 40)])
def test_against_loops(spark, text, how):
    assert got(spark, text, margin=how[0], budget=how[1], most=how[2]) == plain(text or "", *how)


def test_islands_and_budget_are_columns(spark):
    plan = spark.createDataFrame([("5%",)], "t string").select(X.figure_excerpt(F.col("t")))._jdf.queryExecution().toString()
    assert not re.search("Python|Exchange|Generate", plan)
