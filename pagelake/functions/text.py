"""Text measures as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FIGURE_KINDS, INVISIBLE, STATISTIC_BODY, WS

#: The edge of a word of ASCII letters, digits and underscores; Java's own takes other letters in before version 19.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: A statistic may not follow a word character or a full stop.
STATISTIC = r"(?i)(?<![\w.])" + STATISTIC_BODY.replace(r"\b", EDGE)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often it is used, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words between white space; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def shingles(text: Column, n: int = 8) -> Column:
    """Distinct runs of n words; a shorter text is one shingle, an empty one has none."""

    def of(w: Column) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(run)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return bind(words(text), of)


def statistics(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(STATISTIC), F.lit(0))


def figure_kind(token: Column) -> Column:
    """The first kind that matches, else other."""
    out = F.when(F.lit(False), "")
    for kind, rx in FIGURE_KINDS:
        out = out.when(F.trim(token).rlike(rx), kind)
    return out.otherwise("other")


def syllables(w: Column) -> Column:
    """Syllables of a word of lower-case letters."""
    n = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
    n = n - F.when(w.endswith("e") & ~w.rlike("(le|ee|ye)$") & (n > 1), 1).otherwise(0)
    return F.when(w == "", 0).otherwise(F.greatest(n, F.lit(1)))


def readability(text: Column) -> Column:
    """struct(n_words, sentences, syllables, words_per_sentence, flesch); flesch is null without words or sentences."""
    parts = F.filter(F.split(text, r"[.!?]+(?=\s|$)", -1), lambda s: F.trim(F.regexp_replace(s, r"\s", " ")) != "")

    def of(x: Column) -> Column:
        n, sentences, syl = x["n"], x["s"], x["y"]
        ok = (n > 0) & (sentences > 0)
        wps, spw = n / sentences, syl / n
        return F.struct(
            n.cast("long").alias("n_words"), sentences.cast("long").alias("sentences"), syl.cast("long").alias("syllables"),
            F.when(ok, F.round(wps, 1)).alias("words_per_sentence"),
            F.when(ok, F.round(F.lit(206.835) - F.lit(1.015) * wps - F.lit(84.6) * spw, 1)).alias("flesch"),
        )

    def count(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.size(parts).alias("s"), F.aggregate(w, F.lit(0), lambda a, x: a + bind(F.regexp_replace(F.lower(x), "[^a-z]", ""), syllables)).alias("y"))

    return bind(bind(F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0)), count), of)


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur."""
    return bind(F.lower(text), lambda low: F.size(F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, p)))).cast("long")


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases occurs."""
    return bind(F.lower(text), lambda low: F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, p)))


def phrase_total(text: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of all phrases, each counted without overlap."""
    def count(low: Column) -> Column:
        each = F.transform(F.array(*(F.lit(p) for p in phrases)), lambda p: ((F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    return bind(F.lower(text), count)


def invisible_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "".join(INVISIBLE), ""))).cast("long")


def contains_norm(haystack: Column, needle: Column) -> Column:
    """Containment by letters and digits; of a needle of over 12 words the first 12 suffice."""
    def norm(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))

    n, h = norm(needle), norm(haystack)
    w = F.split(n, " ")
    return (n != "") & (F.contains(h, n) | ((F.size(w) > 12) & F.contains(h, F.array_join(F.slice(w, 1, 12), " "))))


def most_of_one_invisible(text: Column) -> tuple[Column, Column]:
    """(most occurrences of one character without width, soft hyphens aside; soft hyphens)."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    soft = "\u00ad"
    return F.greatest(*(count(c) for c in INVISIBLE if c != soft)), count(soft)


def agrees(name: Column, title: Column) -> Column:
    """One contains the other, or they share a third of the words of the shorter one."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(title))
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    need = F.greatest(F.floor(F.least(F.size(x), F.size(y)) / 3), F.lit(1))
    return F.contains(a, b) | F.contains(b, a) | (F.size(F.array_intersect(x, y)) >= need)
