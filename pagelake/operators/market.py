"""Keywords, demand, captures and recorded model answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.constants import INTENTS, KEYWORD_STOP, PREPOSITIONS, QUESTION_WORDS
from pagelake.functions.text import collapse
from pagelake.operators import reports as R


def intent(phrase: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, rx in INTENTS:
        out = out.when(phrase.rlike(rx), name)
    return out.otherwise("informational")


def tokens(phrase: Column) -> Column:
    """Distinct content words, sorted."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(phrase), F.lit("[a-z0-9']+"), F.lit(0)))
    return F.array_sort(F.filter(w, lambda x: (F.length(x) > 1) & ~x.isin(*KEYWORD_STOP)))


def variations(seed: str) -> list[str]:
    """The seed, with each letter behind it, question words before it, prepositions behind it."""
    return [seed, *(f"{seed} {chr(c)}" for c in range(97, 123)), *(f"{q} {seed}" for q in QUESTION_WORDS), *(f"{seed} {p}" for p in PREPOSITIONS)]


def variations_of(seed: Column) -> Column:
    """variations() of a column."""
    letters = F.array(*(F.lit(chr(c)) for c in range(97, 123)))
    behind = lambda words: F.transform(words, lambda w: F.concat(seed, F.lit(" "), w))
    before = F.transform(F.array(*map(F.lit, QUESTION_WORDS)), lambda w: F.concat(w, F.lit(" "), seed))
    return F.concat(F.array(seed), behind(letters), before, behind(F.array(*map(F.lit, PREPOSITIONS))))


def suggestions_ranked(s: DataFrame, seed: str, most: int = R.KEYWORDS) -> DataFrame:
    """The suggestions seen most often, ties by the phrase, with how many are left out."""
    return R.capped(merge_suggestions(s, seed), most, F.desc("seen"), F.asc("phrase"))


def language_tag(lang: Column) -> Column:
    """Whether it is a language tag: two or three letters, then parts of two to eight letters or digits."""
    return lang.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$")


def merge_suggestions(s: DataFrame, seed: str) -> DataFrame:
    """suggestions(engine, variation, phrase, error) -> (phrase, sources, seen, intent), most seen first."""
    p = collapse(F.lower("phrase"))
    good = s.where(F.col("error").isNull()).select("engine", p.alias("phrase")).where((F.col("phrase") != "") & F.contains("phrase", F.lit(seed.lower().split()[0])))
    return good.groupBy("phrase").agg(F.array_sort(F.collect_set("engine")).alias("sources"), F.count("*").alias("seen")).withColumn("intent", intent(F.col("phrase")))


def engine_failures(s: DataFrame) -> DataFrame:
    return s.where(F.col("error").isNotNull()).groupBy("engine").agg(F.count("*").alias("failures"))


def cluster(phrases: DataFrame, threshold: float = 0.5) -> DataFrame:
    """phrases(ord, phrase) -> (ord, phrase, intent, cluster): greedy within an intent, richest phrases first.

    A cluster is named by the least ord in it. Clusters never cross intents, so intents are apart.
    """
    df = phrases.where(F.trim("phrase") != "").select("ord", "phrase", intent(F.col("phrase")).alias("intent"), tokens(F.col("phrase")).alias("tokens"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[set, list[int]]] = []
        holds: dict[str, set[int]] = {}  # token -> groups that have it: others share nothing
        rows = sorted(zip(pdf["tokens"], pdf["ord"], strict=True), key=lambda r: (-len(r[0]), r[1]))
        for tok, o in rows:
            t = set(tok)
            for g in sorted(set().union(*(holds.get(x, ()) for x in t))) if threshold > 0 else range(len(groups)):
                have, members = groups[g]
                if len(t & have) / max(1, len(t | have)) >= threshold:
                    members.append(o)
                    have |= t
                    break
            else:
                g = len(groups)
                groups.append((t, [o]))
            for x in t:
                holds.setdefault(x, set()).add(g)
        name = {o: min(m) for _, m in groups for o in m}
        return pd.DataFrame({"ord": pdf["ord"], "phrase": pdf["phrase"], "intent": pdf["intent"], "cluster": pdf["ord"].map(name)})

    return df.groupBy("intent").applyInPandas(greedy, "ord int, phrase string, intent string, cluster int")


def demand_index(c: DataFrame) -> DataFrame:
    """components(seed, component, score, weight) -> (seed, demand_index, confidence); a null score is not 0."""
    has = F.col("score").isNotNull()
    w = F.sum(F.when(has, F.col("weight")))
    return c.groupBy("seed").agg(F.round(100 * F.try_divide(F.sum(F.col("score") * F.col("weight")), w), 1).alias("demand_index"), F.round(F.coalesce(w, F.lit(0)) / 100, 2).alias("confidence"))


def interest(series: DataFrame) -> DataFrame:
    """series(topic, month, views) -> (topic, months, average, trend); under four months no trend."""
    w = Window.partitionBy("topic")
    s = series.withColumn("i", F.row_number().over(w.orderBy("month"))).withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("n") / 2)
    a = s.groupBy("topic", "n").agg(F.avg(F.when(F.col("i") <= half, F.col("views"))).alias("a"), F.avg(F.when(F.col("i") > half, F.col("views"))).alias("b"), F.floor(F.avg("views")).cast("long").alias("average"))
    ch = F.coalesce(F.try_divide(F.col("b") - F.col("a"), "a"), F.lit(0.0))
    return a.select("topic", F.col("n").alias("months"), "average", F.when(F.col("n") >= 4, F.when(ch > 0.15, "rising").when(ch < -0.15, "falling").otherwise("steady")).alias("trend"))


def corpus_presence(captures: DataFrame) -> DataFrame:
    """captures(domain, crawl, url, status, mime, unreachable) -> per domain counts; unreachable crawls are unknown, not zero."""
    live = ~F.col("unreachable")
    out = captures.groupBy("domain").agg(
        F.count_distinct("crawl").alias("checked"), F.count_distinct(F.when(F.col("unreachable"), F.col("crawl"))).alias("unreachable"), F.count_distinct(F.when(live & F.col("url").isNotNull(), F.col("crawl"))).alias("present"),
        F.count(F.when(live, F.col("url"))).alias("captures"), F.count_if(live & F.col("status").startswith("2")).alias("status_2xx"), F.count_if(live & F.contains("mime", F.lit("html"))).alias("html"), F.count_distinct(F.when(live, F.col("url"))).alias("urls"),
    )
    v = F.when(F.col("checked") == F.col("unreachable"), "not measured").when((F.col("present") == 0) & (F.col("unreachable") == 0), "absent").when(F.col("unreachable") > 0, "partly known").otherwise("present")
    return out.withColumn("verdict", v)


def model_chain(answers: DataFrame) -> DataFrame:
    """answers(prompt, position, model, answer): the first model in the chain that answered."""
    return answers.where(F.col("answer").isNotNull()).groupBy("prompt").agg(F.min_by(F.struct("model", "answer"), "position").alias("a")).select("prompt", "a.model", "a.answer")


def rates(answers: DataFrame) -> DataFrame:
    """answers(brand, prompt, asked, mentioned, rank) -> (brand, asked, mentioned, rate, best_rank); no rate where nothing was asked."""
    asked = F.count_if("asked")
    n = F.count_if(F.col("asked") & F.col("mentioned"))
    return answers.groupBy("brand").agg(asked.alias("asked"), n.alias("mentioned"), F.round(F.try_divide(n, asked), 3).alias("rate"), F.min("rank").alias("best_rank"))


def competitors(named: DataFrame) -> DataFrame:
    """named(ord, prompt, name) -> (name as first written, times, prompts)."""
    g = named.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "ord").alias("name"), F.count("*").alias("times"), F.count_distinct("prompt").alias("prompts"))
    return g.select("name", "times", "prompts")


def competitors_ranked(named: DataFrame, most: int = R.COMPETITORS) -> DataFrame:
    """The competitors named most often, ties by prompts and name, with how many are left out."""
    return R.capped(competitors(named), most, F.desc("times"), F.desc("prompts"), F.asc("name"))


# How answers mark an item of a list.
_NUMBERED = r"^\s{0,3}\d+[.)]\s+(\S.*)$"
_BOLD_NUMBERED = r"^\s{0,3}\*\*\s*\d+[.)]\s*([^*]+?)\s*\*\*"
_HEADING_BOLD = r"^\s{0,3}#{2,4}\s+.*?\*\*([^*]+)\*\*"
_BOLD_LEAD = r"^\s{0,3}\*\*([^*]+)\*\*"
_HEADING = r"^\s{0,3}#{2,4}\s+(\S.*)$"
_ROW = r"^\s*\|\s*([^|]+?)\s*\|"
_BOLD_BULLET = r"^\s{0,3}[-*•]\s+\*\*([^*]+)\*\*"
# Structures that mark an item, the strongest first.
TIERS = ((_NUMBERED, _BOLD_NUMBERED), (_HEADING_BOLD, _BOLD_LEAD), (_HEADING, _ROW), (_BOLD_BULLET,))


def ranked_items(answer: Column) -> Column:
    """An answer's recommendations in order, by the first tier that has two of them; native expressions only."""
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), r"\r?\n"), lambda x: ~x.rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    tiers = []
    for patterns in TIERS:
        def label(line: Column, patterns: tuple[str, ...] = patterns) -> Column:
            raw = F.coalesce(*(F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in patterns))
            return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?U)^[^\w(]+", ""), r"^[*_ ]+|[*_ ]+$", ""))
        got = F.filter(F.transform(lines, lambda x: label(x)), lambda x: x.isNotNull() & (x != "") & ~x.endswith(":") & ~x.rlike("(?i)^(tool|name|option|---)"))
        tiers.append(got)
    out = F.array().cast("array<string>")
    for t in reversed(tiers):
        out = F.when(F.size(t) >= 2, t).otherwise(out)
    return out


def rank_of(items: Column, name: Column) -> Column:
    """1-based place of the first item that names it; null with under three items."""
    rx = F.concat(F.lit(r"(?i)\b"), F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"\b"))
    hits = F.transform(items, lambda x: F.regexp_like(x, rx))
    at = F.array_position(hits, F.lit(True))
    return F.when((F.size(items) >= 3) & (at > 0), at.cast("int"))


def json_tolerant(raw: Column) -> Column:
    """The JSON inside an answer: as it is, without fences, or the outermost braces or brackets; null if none parses."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    tries = (raw, bare, F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.regexp_extract(bare, r"(?s)(\[.*\])", 1))
    return F.coalesce(*(F.when(F.trim(t) != "", F.to_json(F.try_parse_json(t))) for t in tries))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


# Keys whose values change from run to run.
VOLATILE = ("ttfb_ms", "total_ms", "duration_ms", "elapsed_ms", "elapsed_seconds", "fetched_at", "measured_at")


def stable_json(raw: str | None) -> str | None:
    """Canonical JSON without volatile keys at any depth: sorted keys, no spaces."""
    import json

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k not in VOLATILE}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return None if raw is None else json.dumps(strip(json.loads(raw)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stable_digest(df: DataFrame, col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(stable=[stable_json(x) for x in pdf[col]])

    out = df.mapInPandas(run, f"{_ddl(df)}, stable string")
    return out.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2(F.col("stable").cast("binary"), 256))).drop("stable")


#: Characters of a sentence that are shown, and those around an address.
_SHOWN, _AROUND = 300, 120


def mention_evidence(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """answers(id, brand, text), brands(brand, aliases, host) -> (id, brand, matched, position, context) of the answers that name their brand.

    The first alias in order that stands in the text as whole words, with the sentence around it; failing
    all, the host's address with what surrounds it. Aliases of one character name nothing. position counts from 0.
    """
    return contexts(places(answers.join(brands, "brand"), "(?i)"), "id", "brand")


def places(j: DataFrame, flags: str) -> DataFrame:
    """Rows that hold an answer and a brand -> (id, brand, text, host, a_, at_, h_) of those that name it; flags: those of the regex."""
    text = F.col("text")
    rx = lambda a: F.concat(F.lit(rf"{flags}\b\Q"), a, F.lit(r"\E\b"))
    hits = F.transform(F.filter("aliases", lambda a: F.length(a) >= 2), lambda a: F.struct(a.alias("a"), F.call_function("regexp_instr", text, rx(a)).alias("at")))
    first = F.try_element_at(F.filter(hits, lambda h: h["at"] > 0), F.lit(1))
    by_host = F.when(F.coalesce("host", F.lit("")) != "", F.instr(F.lower(text), F.lower(F.col("host"))) - 1).otherwise(-1)
    # made by a generator, a place is looked for once; a filter on a projection would repeat the regexes
    place = F.transform(F.array(first), lambda f: F.struct(f["a"].alias("a_"), F.coalesce(f["at"] - 1, F.lit(-1)).alias("at_"), by_host.alias("h_")))
    return j.select("id", "brand", "text", "host", F.inline(place)).where("at_ >= 0 OR h_ >= 0")


def contexts(found: DataFrame, *kept: str) -> DataFrame:
    """places() -> what is kept of them, matched, position and context."""
    text = F.col("text")
    before, end = F.substring(text, F.lit(1), F.col("at_")), F.col("at_") + F.length("a_")
    dot = F.instr(F.reverse(before), F.lit("."))
    start = F.when(dot > 0, F.col("at_") - dot + 1).otherwise(0)
    stop = F.instr(F.substring(text, end + 1, F.length(text)), F.lit("."))
    sentence = F.substring(text, start + 1, F.when(stop > 0, end + stop).otherwise(F.length(text)) - start)
    lo = F.greatest(F.col("h_") - _AROUND, F.lit(0))
    near = F.substring(text, lo + 1, F.col("h_") + _AROUND - lo)
    named = F.col("at_") >= 0
    strip = lambda c: F.regexp_replace(c, r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$", "")
    return found.select(*kept, F.when(named, F.col("a_")).otherwise(F.col("host")).alias("matched"), F.when(named, F.col("at_")).otherwise(F.col("h_")).cast("long").alias("position"), F.when(named, F.substring(strip(sentence), 1, _SHOWN)).otherwise(strip(near)).alias("context"))


def title_agreement(d: DataFrame) -> DataFrame:
    """Whether a headline contradicts the title: no containment, and under a third of the shorter one's words shared."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    t, h = words(F.col("title")), words(F.col("headline"))
    inside = F.contains(F.lower("title"), F.lower("headline")) | F.contains(F.lower("headline"), F.lower("title"))
    need = F.greatest(F.lit(1), F.floor(F.least(F.size(t), F.size(h)) / 3).cast("int"))
    return d.select("id", (~inside & (F.size(F.array_intersect(t, h)) < need)).alias("contradicts"))


def heading_skips(d: DataFrame) -> DataFrame:
    prev = F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    return d.withColumn("prev", prev).where("level > prev + 1").select("page_id", F.col("prev").alias("from_level"), F.col("level").alias("to_level"))


def guard_static(d: DataFrame) -> DataFrame:
    """Whether a URL may be fetched, as far as its text tells: http(s), usual port, no private or local host."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    port = F.regexp_extract("url", r"^[a-z]+://[^/:?#]+:(\d+)", 1)
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.)")
    return d.select("id", (F.col("url").rlike("^https?://") & port.isin("", "80", "443") & ~private).alias("allowed"))
