"""What must hold of the results of the services, observed in the pass that makes them.

A flag is an aggregate over the result's rows that Spark collects while the result is written, so nothing is
computed or read a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagelake.operators import audits as A
from pagelake.operators import page_checks as C

#: (name, flag) of what must hold; a flag is an aggregate that is true, or null without rows.
Flags = tuple[tuple[str, Column], ...]
_KNOWN = ("critical", "high", "low", "info")


def ordered_findings(facts: DataFrame, *prefixes: str) -> DataFrame:
    """(page_id, status, findings): all findings of a page as one list, the most severe first, then by code; a page is a row."""
    rows = F.flatten(F.transform(C.found_rows(*prefixes), lambda r: F.transform(r["found"], lambda x: F.struct(A.rank(x["severity"]).alias("rank"), x["code"].alias("code"), x["severity"].alias("severity")))))
    return facts.select("page_id", "status", F.array_sort(rows).alias("findings"))


def page_audit() -> Flags:
    """Of ordered_findings: pages were fetched, codes have a prefix, severities are known, the worst stand first."""
    ranks = F.transform("findings", lambda x: A.rank(x["severity"]))
    return (
        ("page_was_fetched", F.bool_and(F.col("status").isNotNull())), ("findings_have_codes", F.bool_and(F.forall("findings", lambda x: x["code"].rlike("^[a-z0-9]+[.][a-z0-9_]+$")))),
        ("severities_known", F.bool_and(F.forall("findings", lambda x: x["severity"].isin(*_KNOWN)))), ("findings_ordered_by_severity", F.bool_and(ranks == F.array_sort(ranks))),
    )


def geo_score() -> Flags:
    """Of scores: between 0 and 100, not above what is possible, a known band."""
    return (
        ("score_in_range", F.bool_and(F.col("score").between(0, 100))), ("score_within_possible", F.bool_and(F.col("score") <= F.col("possible"))),
        ("band_known", F.bool_and(F.col("band").isin("excellent", "good", "foundation", "critical"))),
    )


def site_graph(tolerance: float = 0.01) -> Flags:
    """Of ranks: none negative, together 1 but for rounding; every node has a link."""
    return (
        ("ranks_not_negative", F.bool_and(F.col("score") >= 0)), ("ranks_sum_to_one", F.abs(F.sum("score") - 1) <= tolerance),
        ("nodes_have_links", F.bool_and(F.col("inbound") + F.col("outbound") > 0)),
    )


def audit_diff() -> Flags:
    """Of differences: a known change, weights on the sides that the change says."""
    before, after = F.col("before").isNotNull(), F.col("after").isNotNull()
    agrees = F.when(F.col("change") == "fixed", before & ~after).when(F.col("change") == "introduced", ~before & after).otherwise(before & after)
    return (("change_known", F.bool_and(F.col("change").isin("fixed", "introduced", "remaining"))), ("sides_agree_with_change", F.bool_and(agrees)), ("codes_named", F.bool_and(F.coalesce("code", F.lit("")) != "")))


def content_charts() -> Flags:
    """Of charts: no more figures are chartable than detected, a table where there are figures and only there, nothing without a chartable value."""
    some = F.col("figures") > 0
    return (
        ("chartable_are_detected", F.bool_and(F.col("chartable") <= F.col("detected"))), ("table_follows_figures", F.bool_and((F.col("html").isNotNull() == some) & (F.col("jsonld").isNotNull() == some))),
        ("no_table_without_figures", F.bool_and((F.col("chartable") > 0) | ~some)),
    )


def watched(result: DataFrame, service: str, flags: Flags) -> tuple[DataFrame, Observation]:
    """The result, whose next action fills the observation with the flags and the number of rows."""
    seen = Observation(service)
    return result.observe(seen, F.count(F.lit(1)).alias("rows"), *(f.alias(n) for n, f in flags)), seen


def settled(result: DataFrame, service: str, flags: Flags, write: Callable[[DataFrame], None] | None = None) -> list[tuple[str, str, bool, int]]:
    """Writes the result (nowhere, unless told where) and returns (service, check, passed, rows); a flag that no row speaks to has passed."""
    df, seen = watched(result, service, flags)
    if write is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        write(df)
    got = seen.get
    return [(service, n, got[n] is not False, got["rows"]) for n, _ in flags]
