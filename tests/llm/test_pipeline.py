"""The pipeline against plain versions of its stages."""

import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from pagelake.llm import decontaminate  # noqa: E402
from pagelake.llm.queries import tokenizer_path  # noqa: E402

from ..oracle import SF  # noqa: E402
from .brute import jaccard  # noqa: E402


def test_pipeline(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pipeline.run(spark, SF).collect()
    kept = {d: r for d, r in docs.items() if r.text and any(c.isalpha() for c in r.text)}
    kept = {d: kept[d] for d, (_, c) in jaccard({d: r.text for d, r in kept.items()}).items() if c == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, r in kept.items() if any(" ".join(decontaminate.words(t)) in " ".join(decontaminate.words(r.text)) for _, t in items)}
    kept = {d: r for d, r in kept.items() if d not in leaks}
    assert {r.doc_id for r in got} <= set(kept)
    size = {d: len(r.text.encode().split()) for d, r in kept.items()}
    total = 1.5 * sum(size.values())
    by = {}
    for d, r in kept.items():
        by.setdefault(r.source, []).append(d)
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = total - sum(2 * sum(size[d] for d in by[s]) for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        new = {s for s in share if share[s] > 2 * sum(size[d] for d in by[s])}
        if not new:
            break
        capped |= new
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r)
    full = {d: (len(i) + 1, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*i, 2]))) for d in have for i in [tok.encode(kept[d].text, add_special_tokens=False).ids]}
    whole = sum((r.n_tokens, r.ids_crc32) == full[r.doc_id] for r in got)
    assert whole >= len(got) - len(names)  # one cut copy a source at most
    for s in names:
        target = share.get(s, 2 * sum(size[d] for d in by[s]))
        n = sum(size[d] * len(have.get(d, [])) for d in by[s])
        assert target - 1 <= n <= target + max(size[d] for d in by[s])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.STAGES[0][1](spark, docs, SF)
    assert out.columns == docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "source_mixing", "token_output"]


DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, row_key long, leak long, taken long, words long, repeated int, score double"
NEAR = " ".join(f"the word number {i} and" for i in range(40))
OTHER = " ".join(f"some other {i} is here" for i in range(40))


def odd(rows):
    return [(d, t, lang, source, len(t or ""), "k", 1, 2, 3, 4, 5, 0.5) for d, t, lang, source in rows]


ROWS = odd([
    (5, NEAR, "en", "a"), (None, NEAR, "en", "a"), (None, NEAR + " x", "en", "b"), (7, NEAR + " y", "en", None), (7, OTHER, "en", "a"), (7, OTHER, "en", "a"), (None, OTHER + " z", "en", "a"), (None, "quite alone here", "en", "a"),
    (8, None, "en", "a"), (9, "", "en", "a"), (10, "12 34 !?", None, "b"), (11, "long " * 30_000, "en", "b"), (12, "tiny", None, None),
])


def stage(name):
    return dict(pipeline.STAGES)[name]


@pytest.fixture
def bench(spark, tmp_path):
    spark.createDataFrame([(1, "What is the name of the town by the green river? It is called Quuxville on Water."), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_language_stage_odd_rows(spark, bench):
    out = stage("language_id")(spark, spark.createDataFrame(ROWS, DDL), bench)
    assert out.columns == [c.split()[0] for c in DDL.split(", ")]
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 0, 0, 5, 7, 7, 7, 11, 12]


def test_jaccard_stage_odd_rows(spark, bench):
    got = sorted((r.doc_id or 0, r.text) for r in stage("jaccard_join")(spark, spark.createDataFrame(ROWS, DDL), bench).select("doc_id", "text").collect() if r.text)
    # of the first group the row of id 5 stays, of the second one row of id 7
    assert got == [(0, "quite alone here"), (5, NEAR), (7, OTHER), (10, "12 34 !?"), (11, "long " * 30_000), (12, "tiny")]


def test_decontamination_stage_odd_rows(spark, bench):
    item = "What is the name of the town by the green river? It is called Quuxville on Water."
    rows = odd([(None, "before " * 30 + item, "en", "a"), (None, "clean text", "en", "a"), (7, item, "en", "a"), (7, "clean too", "en", "a"), (8, None, "en", "a"), (9, "", "en", "a"), (10, "pad " * 40_000 + item, "en", "a")])
    out = stage("decontamination")(spark, spark.createDataFrame(rows, DDL), bench).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, "clean text"), (7, "clean too"), (8, ""), (9, "")]


def test_mixing_stage_odd_rows(spark, bench):
    docs = spark.createDataFrame(ROWS, DDL)
    out = stage("source_mixing")(spark, docs, bench).collect()
    size = lambda t: len((t or "").split())
    total = sum(size(r[1]) for r in ROWS)
    assert abs(sum(size(r.text) for r in out) - 1.5 * total) <= 3
    assert {r.kept for r in out} == {"k"} and all(any((r[1] or "").startswith(x.text) for r in ROWS) for x in out)


def test_token_stage_odd_rows(spark, bench):
    out = sorted(stage("token_output")(spark, spark.createDataFrame(ROWS, DDL), bench).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_of_an_empty_table(spark, bench, name):
    out = stage(name)(spark, spark.createDataFrame([], DDL), bench)
    assert out.collect() == []
    assert name == "token_output" or out.columns == [c.split()[0] for c in DDL.split(", ")]
