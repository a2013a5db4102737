"""Table functions that SQL can call for each row, LATERAL: passages and structured data of a page's html.

They work on one page at a time and hand rows over in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagelake.functions.facts import parse, text_of, typed_nodes, walk
from pagelake.operators.chunks import MAX_WORDS, spans

CHUNKS = "ord int, heading string, text string, start int, stop int, source string"
JSONLD = "block int, ord int, type string, name string, node string, error string"


class Chunks:
    """chunks(html[, most]): the citable passages of a page, up to `most` words each (40 to 600); none of a null page."""

    def eval(self, html: str, most: int = MAX_WORDS) -> Iterator[tuple]:
        if html is not None:
            for i, span in enumerate(spans(html, min(600, max(40, most if most is not None else MAX_WORDS)))):
                yield i, *span


class JsonLd:
    """jsonld(html): each typed node of a page's JSON-LD, at any depth; a block that does not parse is one row with an error."""

    def eval(self, html: str) -> Iterator[tuple]:
        root, _ = parse(html or "")
        blocks = [text_of(e) for e in walk(root) if e.tag == "script" and "ld+json" in e.attrs.get("type", "").lower()]
        for i, raw in enumerate(blocks):
            try:
                found = [n for n, _ in typed_nodes(json.loads(raw))]
            except ValueError as e:
                yield i, -1, None, None, None, type(e).__name__
                continue
            for k, n in enumerate(found):
                own = n["@type"] if isinstance(n["@type"], list) else [n["@type"]]
                name = n.get("name")
                for t in own:
                    if isinstance(t, str):
                        yield i, k, t.split("/")[-1], name if isinstance(name, str) else None, json.dumps(n, separators=(",", ":"), ensure_ascii=False), None


def register(spark: SparkSession) -> None:
    """Make chunks() and jsonld() callable from the session's SQL."""
    spark.udtf.register("chunks", udtf(Chunks, returnType=CHUNKS, useArrow=True))
    spark.udtf.register("jsonld", udtf(JsonLd, returnType=JSONLD, useArrow=True))
