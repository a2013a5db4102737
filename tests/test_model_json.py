"""JSON of models: what a cut-off document still says."""

import json

import pytest
from pyspark.sql import functions as F

from pagelake.functions import model_json as J

CASES = [
    ('```json\n{"figures":[{"label":"a","value":"1"},{"label":"b","value":"2"},{"label":"c', {"figures": [{"label": "a", "value": "1"}, {"label": "b", "value": "2"}]}),
    ('[{"a":1},{"b":2},{"c', [{"a": 1}, {"b": 2}]), ('{"x":{"y":[{"a":1},{"b":2},{"bro', {"x": {"y": [{"a": 1}, {"b": 2}]}}), ('{"figures":[{"label":"Revenue","value":"4', {"figures": [{"label": "Revenue"}]}),
    ('{"question": "What is', None), ('{"a":1,"b":[1,2,3]}', {"a": 1, "b": [1, 2, 3]}), ('{"figures":[{"label":"a {weird} [name]","value":"1"},{"lab', {"figures": [{"label": "a {weird} [name]", "value": "1"}]}),
    (r'{"figures":[{"label":"say \"hi\"","value":"1"},{"lab', {"figures": [{"label": 'say "hi"', "value": "1"}]}), ('{"question": "q", "answered": true, "audience": "x', {"question": "q", "answered": True}),
    ('{"figures": [{"a":1},{"b":2},{"l": "ha', {"figures": [{"a": 1}, {"b": 2}]}), ("[1, 2, 3", [1, 2]), ("[1", None), ("", None), (None, None), ("no JSON at all", None), ("}{", None), ("[]", []), ("{} trailing", {}),
    ('<think>{"not": "this"}</think>{"a": 1, "b"', {"a": 1}), ('<scratchpad>[1,2', None), ('Here: {"a": [1, {"b": "c\\\\", "d', {"a": [1, {"b": "c\\"}]}), ('{"a": 1]', None), ('{"a": 1, "b": 2]', {"a": 1}), ('["\\', None), ("[" * 5000, None), ('{"a": "é日", "b": "', {"a": "é日"}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string").select(J.salvaged(F.col("x")).alias("y"))
    got = df.first().y
    assert (None if got is None else json.loads(got)) == want


def test_cut_at_every_length_invents_nothing():
    """What is saved is a part of the document: the same values in the same places, the last ones missing."""
    doc = {"a": [1, "two", {"b": None, "c": [True, 2.5, "x,]}\\\""]}], "d": {"e": "f"}, "g": "é"}
    text = json.dumps(doc, ensure_ascii=False)

    def part(x, of):
        if isinstance(x, dict):
            return isinstance(of, dict) and list(of)[: len(x)] == list(x) and all(part(v, of[k]) for k, v in x.items())
        if isinstance(x, list):
            return isinstance(of, list) and len(x) <= len(of) and all(map(part, x, of))
        return x == of and type(x) is type(of)

    sizes = []
    for i in range(len(text) + 1):
        got = J.whole_part(text[:i])
        assert got is None or part(json.loads(got), doc), (i, got)
        sizes.append(len(got or ""))
    assert sizes == sorted(sizes) and json.loads(J.whole_part(text)) == doc


def test_reasoning_and_shape(spark):
    rows = [("<think>hm</think>Yes.", "Yes."), ("<thinking a=1>never ends", ""), ("plain", "plain"), ("A <reasoning>x\ny</reasoning> B", "A  B"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, want string")
    assert all(r.got == r.want for r in df.select(J.without_reasoning(F.col("x")).alias("got"), "want").collect())
    rows = [('[{"a": 1}]', '{"figures": [{"a": 1}]}'), ('{"figures": [1]}', '{"figures": [1]}'), ("not json", "{}"), (None, "{}"), ("", "{}"), (" []", '{"figures":  []}')]
    df = spark.createDataFrame(rows, "x string, want string")
    assert all(r.got == r.want for r in df.select(J.as_object(F.col("x"), "figures").alias("got"), "want").collect())


def test_all_cuts_in_one_walk(spark):
    """The same as each cut by itself, and no row for each length of a long document."""
    texts = ['{"a":[1,"two",{"b":null,"c":[true,2.5,"x,]}\\\\\\""]}],"g":"é"} rest', '[[1,2],[3', '{"a": 1]', '{"a" 1, "b": 2}', "", "none", 'so: {"a":[1,2]}', '{"x":["a<thinker","b"],"y":1}', '{"x":["a``","b"],"y":1}', '{"a":1,}', "{]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, doc string")
    got = {}
    for r in J.salvaged_cuts(df, "doc").collect():
        got.update({(r.id, c): r.salvaged for c in range(r.first_cut, r.first_cut + r.cuts)})
    each = df.select("id", F.expr("explode(transform(sequence(0, length(doc)), i -> struct(i, substring(doc, 1, i) AS x)))").alias("c")).select("id", "c.i", J.salvaged(F.col("c.x")).alias("y"))
    assert got == {(r.id, r.i): r.y for r in each.collect()}
    long = spark.createDataFrame([("[" + '"' + "x" * 100_000 + '",1]',)], "doc string")
    assert J.salvaged_cuts(long, "doc").count() == 3
