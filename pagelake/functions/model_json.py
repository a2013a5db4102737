"""JSON that a model wrote: found, salvaged when it was cut off, and brought into the shape asked for."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

#: A string with its closing quote, if it has one, or a character that opens, closes or parts values.
_MARK = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}\[\],]', re.S)
_CLOSING = {"{": "}", "[": "]"}
_FENCES = r"^\s*```(?i:json)?\s*|\s*```\s*$"
# The tags in which models wrap what is not the answer.
_REASONING = r"(?is)<(think|thinking|reasoning|scratchpad)\b[^>]*>.*?(?:</\1>|\z)"


def whole_part(text: str | None) -> str | None:
    """The complete part of the JSON that text begins with at its first brace or bracket, compact; None if no value is complete.

    Walks over the marks with a stack of what would close the open containers. Wherever an element has just
    closed, and before each comma, the text could end: closed from there it says nothing that was not
    written. A value that was cut off is left out, with the key it belongs to.
    """
    *_, last = _ends(text or "")
    return _part(text, *last)


def _part(text: str, length: int, start: int, end: int, closing: str) -> str | None:
    return _compact(text[start:end] + closing) if end else None


def _ends(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(length, start, end, closing) wherever the whole part of the text's first so many characters may change, from 0 on.

    It is the text from start to end with what closes it; nothing if end is 0. A string tells nothing
    before its end, so only the other marks are looked at.
    """
    yield 0, 0, 0, ""
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return
    at = min(starts)
    body = text[at:]
    closing: list[str] = []
    for mark in _MARK.finditer(body):
        c = mark[0]
        if c[0] == '"':
            if not mark[1]:
                return  # cut off within a string
        elif c in _CLOSING:
            closing.append(_CLOSING[c])
        elif c == ",":
            yield at + mark.end(), at, at + mark.start(), "".join(reversed(closing))
        else:
            closing.pop()
            if not closing:
                if _compact(body[: mark.end()]) is not None:
                    yield at + mark.end(), at, at + mark.end(), ""
                return
            yield at + mark.end(), at, at + mark.end(), "".join(reversed(closing))


def _compact(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def without_reasoning(answer: Column) -> Column:
    """The answer without reasoning blocks, closed or cut off."""
    return F.trim(F.regexp_replace(answer, _REASONING, ""))


def without_fences(answer: Column) -> Column:
    return F.regexp_replace(F.trim(answer), _FENCES, "")


@F.pandas_udf(StringType())
def _whole_parts(texts: pd.Series) -> pd.Series:
    return texts.map(whole_part, na_action="ignore")


def salvaged(answer: Column) -> Column:
    """The complete part of an answer's JSON, compact: without reasoning and fences, from the first brace or bracket on.

    Null for a null answer, one without JSON, and one in which not even one value is complete. What is whole comes back whole.
    """
    return _whole_parts(without_fences(without_reasoning(answer)))


@F.pandas_udf(ArrayType(StructType().add("salvaged", StringType()).add("first_cut", IntegerType()).add("cuts", LongType())))
def _parts_of_all_cuts(texts: pd.Series) -> pd.Series:
    def of(text: str) -> list[dict]:
        found = list(_ends(text))
        after = [x[0] for x in found[1:]] + [len(text) + 1]
        return [{"salvaged": _part(text, *x), "first_cut": x[0], "cuts": end - x[0]} for x, end in zip(found, after, strict=True)]

    return texts.map(of, na_action="ignore")


#: Where the salvage of a cut document depends on more than its braces: tags of reasoning, fences, what stands before it.
_WRAPPED = r"(?i)<(?:think|reasoning|scratchpad)|`|\A[^{\[]"


def salvaged_cuts(docs: DataFrame, doc: str) -> DataFrame:
    """All columns, with a row for each run of lengths at which the cut-off text gives the same: (salvaged, first_cut, cuts).

    A text is walked over once, whatever its length; only texts with tags of reasoning, fences or
    anything before the JSON are cut at each length.
    """
    wrapped = F.col(doc).rlike(_WRAPPED)
    plain = docs.where(~wrapped).withColumn("x_", F.explode(_parts_of_all_cuts(F.col(doc)))).select(*docs.columns, "x_.*")
    each = docs.where(wrapped).withColumn("cut_", F.explode(F.sequence(F.lit(0), F.length(doc))))
    each = each.withColumn("salvaged", salvaged(F.substring(F.col(doc), F.lit(1), F.col("cut_"))))
    return plain.unionAll(each.select(*docs.columns, "salvaged", F.col("cut_").alias("first_cut"), F.lit(1).cast("long").alias("cuts")))


def as_object(value: Column, key: str) -> Column:
    """JSON as an object: an object as it is, a bare list under `key`, anything else, null too, an empty one."""
    first = F.substring(F.ltrim(value), 1, 1)
    return F.when(first == "{", value).when(first == "[", F.concat(F.lit(json.dumps({key: 0})[:-2]), value, F.lit("}"))).otherwise("{}")
