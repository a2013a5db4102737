"""Citable passages of a page: consecutive blocks under a heading, packed up to a number of words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pagelake.functions.facts import Element, parse, squeeze, text_of, walk

MAX_WORDS = 220
# Elements and roles that are no content, and the headings that a passage can stand under.
_LEFT_OUT = {"script", "style", "noscript", "template", "svg", "nav", "footer", "header", "aside", "form", "dialog"}
_ROLES = {"navigation", "banner", "search", "complementary", "contentinfo"}
_HEADS = ("h1", "h2", "h3", "h4")


def spans(html: str | None, most: int = MAX_WORDS) -> list[tuple[str, str, int, int, str]]:
    """(heading, text, start, stop, source); offsets run over the spans, one apart. Without blocks, blank lines part the text."""
    root, _ = parse(html or "")

    def prune(x: Element) -> None:
        x.kids = [k for k in x.kids if isinstance(k, str) or k.tag not in _LEFT_OUT and k.attrs.get("role") not in _ROLES]

    for e in walk(root):
        prune(e)
    body = next((e for e in walk(root) if e.tag == "body"), root)
    named = next((e for tag in ("main", "article") for e in walk(body) if e.tag == tag), None) or next((e for e in walk(body) if e.attrs.get("role") == "main"), None)
    if named is not None and len(text_of(named, " ").split()) >= 50:
        body = named
    out: list[tuple[str, str, int, int, str]] = []
    heading, held, at = "", [], 0

    def put(text: str, source: str) -> None:
        nonlocal at
        out.append((heading, text, at, at + len(text), source))
        at += len(text) + 1

    for e in walk(body):
        if e.tag not in (*_HEADS, "p", "li", "td", "blockquote", "pre"):
            continue
        text = squeeze(text_of(e, " "))
        if not text:
            continue
        if e.tag in _HEADS or sum(len(h.split()) for h in held) + len(text.split()) > most:
            if held:
                put(" ".join(held), "block")
            held = []
        if e.tag in _HEADS:
            heading = text
        else:
            held.append(text)
    if held:
        put(" ".join(held), "block")
    if out:
        return out
    for block in "\n".join(line.strip() for line in text_of(body, "\n").split("\n")).split("\n\n"):
        words = block.split()
        if len(words) >= 4:
            for i in range(0, len(words), most):
                put(" ".join(words[i : i + most]), "text")
    return out


def page_chunks(pages: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """pages(page_id, html) -> a row a span."""
    most = min(600, max(40, most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, *s) for p, h in zip(pdf["page_id"], pdf["html"], strict=True) for i, s in enumerate(spans(h, most))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "heading", "text", "start", "stop", "source"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ord int, heading string, text string, start int, stop int, source string")
