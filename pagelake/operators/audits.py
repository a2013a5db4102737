"""Audits against each other: differences, comparisons, fault weights, remedies; and small recorded-response tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.constants import CAPTCHA, CHALLENGE_BODIES, CHALLENGE_HEADERS, PRICES, REMEDIES, SCHEMA_RULES, SEVERITIES

from pagelake.operators import reports as R

#: Bytes beyond which an image is heavy.
HEAVY_BYTES = 500_000


def _lookup(col: Column, at: int, default: int) -> Column:
    m = F.create_map(*(F.lit(v) for s, x in SEVERITIES.items() for v in (s, x[at])))
    return F.coalesce(F.try_element_at(m, col), F.lit(default))


def weight(severity: Column) -> Column:
    return _lookup(severity, 1, 0)


def rank(severity: Column) -> Column:
    return _lookup(severity, 0, 9)


def fault_weight(findings: DataFrame) -> DataFrame:
    """findings(audit, code, severity) -> per audit the weight of every finding, and of distinct codes."""
    by_code = findings.groupBy("audit", "code").agg(F.max(weight(F.col("severity"))).alias("w"), F.sum(weight(F.col("severity"))).alias("s"))
    return by_code.groupBy("audit").agg(F.sum("s").cast("long").alias("all_findings"), F.sum("w").cast("long").alias("by_code"))


def audit_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(code, change): fixed, introduced or remaining; a code counts once."""
    b = before.groupBy("code").agg(F.max(weight(F.col("severity"))).alias("b"))
    a = after.groupBy("code").agg(F.max(weight(F.col("severity"))).alias("a"))
    change = F.when(F.col("a").isNull(), "fixed").when(F.col("b").isNull(), "introduced").otherwise("remaining")
    return b.join(a, "code", "full_outer").select("code", change.alias("change"), F.col("b").cast("long").alias("before"), F.col("a").cast("long").alias("after"))


def direction(diff: DataFrame) -> DataFrame:
    d = diff.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
    return d.withColumn("direction", F.when(F.col("after") < F.col("before"), "improved").when(F.col("after") > F.col("before"), "regressed").otherwise("unchanged"))


def compare(findings: DataFrame) -> DataFrame:
    """findings(side, code) of two sides -> (code, where): ours, theirs or both."""
    g = findings.groupBy("code").agg(F.bool_or(F.col("side") == "ours").alias("o"), F.bool_or(F.col("side") == "theirs").alias("t"))
    return g.select("code", F.when(F.col("o") & F.col("t"), "both").when(F.col("o"), "ours").otherwise("theirs").alias("where_found"))


def remedy_phases(findings: DataFrame) -> DataFrame:
    """findings(code, severity) -> (phase, remedy, codes, severity, cost): remedies whose prefixes are met, worst first."""
    spark = findings.sparkSession
    rows = [(i, name, p, round(sum(PRICES.get(s, 0) for s in services), 4)) for i, (name, prefixes, services) in enumerate(REMEDIES) for p in prefixes]
    rules = spark.createDataFrame(rows, "ord int, remedy string, prefix string, cost double")  # as many rows as there are prefixes
    hit = findings.join(F.broadcast(rules), findings["code"].startswith(rules["prefix"]))
    worst = F.min_by("severity", rank(F.col("severity")))
    g = hit.groupBy("ord", "remedy", "cost").agg(F.slice(F.array_sort(F.collect_set("code")), 1, 8).alias("codes"), worst.alias("severity"))
    phase = F.row_number().over(Window.orderBy(rank(F.col("severity")), "ord"))  # a row a remedy
    return g.select(phase.alias("phase"), "remedy", F.array_join("codes", ",").alias("codes"), "severity", "cost")


def schema_rules(nodes: DataFrame) -> DataFrame:
    """nodes(page_id, type, props) -> (page_id, type, missing, lacking): required and recommended properties not there."""
    spark = nodes.sparkSession
    rules = spark.createDataFrame([(t, need, want) for t, (need, want) in SCHEMA_RULES.items()], "type string, need array<string>, want array<string>")
    j = nodes.join(F.broadcast(rules), "type")
    return j.select("page_id", "type", F.array_join(F.array_except("need", "props"), ",").alias("missing"), F.array_join(F.array_except("want", "props"), ",").alias("lacking"))


def crawler_probe(probes: DataFrame) -> DataFrame:
    """probes(url, agent, status, words, challenged), agent 'browser' is the baseline -> (url, agent, verdict)."""
    base = probes.where("agent = 'browser'").select("url", F.col("status").alias("b_status"), F.col("words").alias("b_words"), F.col("challenged").alias("b_challenged"))
    j = probes.where("agent <> 'browser'").join(base, "url", "left")
    refused = lambda s, c: c | s.isin(401, 403, 429) | (s >= 500)
    v = (
        F.when(F.col("b_status").isNull() | refused(F.col("b_status"), F.col("b_challenged")), "baseline_unavailable").when(F.col("status").isNull(), "untested")
        .when(refused(F.col("status"), F.col("challenged")), "blocked").when((F.col("b_words") >= 50) & (F.col("words") < F.col("b_words") / 2), "degraded").otherwise("allowed")
    )
    return j.select("url", "agent", v.alias("verdict"))


def link_status(probes: DataFrame) -> DataFrame:
    """probes(url, status, final_url, error, internal) -> (url, class): blocked, broken, redirecting or ok, in this order."""
    c = (
        F.when(F.col("error").isNotNull(), "blocked").when((F.col("status") >= 400) | (F.col("status") == 0), "broken")
        .when(F.col("status").between(300, 399) | (F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url"))), "redirecting").otherwise("ok")
    )
    return probes.select("url", c.alias("class"))


def image_weights(probes: DataFrame) -> DataFrame:
    """probes(url, status, bytes) -> (code, n): over 500,000 bytes, and broken."""
    code = F.when((F.col("status") >= 400) | (F.col("status") == 0), "image.broken").when(F.col("bytes") > HEAVY_BYTES, "image.too_large")
    return probes.select(code.alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))


def heaviest(probes: DataFrame, most: int = R.HEAVY) -> DataFrame:
    """probes(page_id, url, status, bytes) -> (page_id, url, bytes, skipped): each page's heaviest images over the limit, and how many more there are.

    Each task hands on `most` of a page at most.
    """
    fine = probes.where((F.col("status") < 400) & (F.col("status") != 0) & (F.col("bytes") > HEAVY_BYTES))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("bytes"), "url"))
    top = fine.withColumn("place_", place).where(F.col("place_") <= most)
    counts = fine.groupBy("page_id").agg(F.count("*").alias("all_"))
    return top.join(counts, "page_id").select("page_id", "url", "bytes", F.greatest(F.col("all_") - most, F.lit(0)).cast("long").alias("skipped"))


def llms_findings(files: DataFrame) -> DataFrame:
    """files(site, body) -> (site, code): a missing, malformed or present llms.txt."""
    code = F.when(F.col("body").isNull() | (F.trim("body") == ""), "llms.missing").when(~F.col("body").rlike(r"(?m)^#\s+\S"), "llms.malformed").otherwise("llms.present")
    return files.select("site", code.alias("code"))


#: Characters of a page that are searched for an anti-bot service, the longest page that may be one's, and the longest good one that names none.
_SEARCHED, _LONGEST, _LONGEST_GOOD = 20_000, 120_000, 40_000
_SOME_SERVICE = "an anti-bot service"


def challenge(df: DataFrame) -> DataFrame:
    """(page_id, vendor, evidence, captcha) of pages of which an anti-bot service was fetched instead; header before body, all null if none was.

    evidence is the header, or the text of the page, by which it was known.
    """
    html = F.coalesce("html", F.lit(""))
    head, long = F.substring(html, 1, _SEARCHED), F.length(html)
    captcha = head.rlike("(?i)" + CAPTCHA)
    none = F.lit(None).cast("struct<vendor:string,evidence:string,captcha:boolean>")
    found = lambda vendor, evidence, c: F.struct(F.lit(vendor).alias("vendor"), evidence.alias("evidence"), c.alias("captcha"))
    by_header, by_body = none, none
    for vendor, name, needle in reversed(CHALLENGE_HEADERS):
        value = F.try_element_at("headers", F.lit(name))
        by_header = F.when(value.isNotNull() & F.contains(F.lower(value), F.lit(needle)), found(vendor, F.lit(name), F.lit(False))).otherwise(by_header)
    for vendor, rx in reversed(CHALLENGE_BODIES):
        short = (long <= _LONGEST) if vendor else (long <= _LONGEST) & ~(F.col("ok") & (long > _LONGEST_GOOD))
        by_body = F.when(short & head.rlike("(?i)" + rx), found(vendor or _SOME_SERVICE, F.substring(F.regexp_extract(head, f"(?i)({rx})", 1), 1, 70), captcha)).otherwise(by_body)
    by_captcha = F.when(~F.col("ok") & captcha, found(_SOME_SERVICE, F.lit("captcha"), F.lit(True)))
    return df.select("page_id", F.coalesce(by_header, by_body, by_captcha).alias("c")).select("page_id", "c.vendor", "c.evidence", "c.captcha")


def auditable(df: DataFrame) -> DataFrame:
    """(page_id, reason): why a page cannot be audited, null if it can."""
    c = challenge(df).withColumnRenamed("page_id", "c_id")
    j = df.join(c, F.col("page_id") == F.col("c_id"))
    s = F.coalesce("status", F.lit(0))
    reason = F.when(F.col("vendor").isNotNull(), "challenged").when((s != 0) & ~F.col("ok"), "error status").when(s == 0, "not fetched").when(F.col("media_type") != "text/html", "not html")
    return j.select("page_id", reason.alias("reason"))


def content_type(header: Column) -> Column:
    media = F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))
    charset = F.lower(F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)charset\s*=\s*([^;]+)", 1), "[\"']", "")))
    return F.struct(media.alias("media"), F.when(charset != "", charset).alias("charset"))


def badge(label: Column, value: Column) -> Column:
    """An SVG badge; widths are six per character and twenty."""
    a, b = F.length(label) * 6 + 20, F.length(value) * 6 + 20
    return F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), (a + b).cast("string"), F.lit('" height="20"><text x="10" y="14">'), label, F.lit('</text><text x="'), (a + 10).cast("string"), F.lit('" y="14">'), value, F.lit("</text></svg>"),
    )
