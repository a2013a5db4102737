"""Where a bound once cut something off: many vectors, named sections, long lists, lines that share a hash."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import embed_dedup, jaccard, line_dedup, token_store, util
from pagelake.llm.html_extract import main_text
from pagelake.llm.queries import tokenizer_path

from .brute import jaccard as brute

PROSE = "The first long sentence of this part says something, and it goes on for a while, as prose does. "


@pytest.mark.parametrize("n", [10**6, 10**9, 10**11, 10**12, 10**15])
def test_tables_reach_their_share_at_any_size(n):
    """The share of pairs at the threshold that meet, measured on other vectors than the tables were planned with."""
    x = np.random.RandomState(3).standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = embed_dedup.plan_tables(x[:2000], n, embed_dedup.THRESHOLD)
    assert 1 <= len(tables) <= embed_dedup.TABLES
    y = embed_dedup.partners(x[2000:], embed_dedup.THRESHOLD)
    met = (embed_dedup.codes(x[2000:], tables) == embed_dedup.codes(y, tables)).any(axis=1).mean()
    assert met * embed_dedup.ENOUGH >= 0.95


@pytest.mark.parametrize("name", ["recommendations", "related", "tags", "alerts", "toc", "disclaimer", "share", "widget", "related widget", "share-tags"])
def test_prose_in_named_sections_of_an_article_stays(name):
    part = f"<section id='{name}'><p>{PROSE * 2}Inner.</p><p>{PROSE}Second.</p></section>"
    links = f"<div class='{name}'><a href='/x'>One of the other stories that we have here</a> <a href='/y'>Another one, which is as long as the first</a></div>"
    body = "".join(f"<p>{PROSE * 3}Number {i}.</p>" for i in range(4))
    got = main_text(f"<body><nav><a href='/'>Home</a></nav><article><h1>Title</h1>{body}{part}{links}</article></body>")
    assert "Inner." in got and "Second." in got and "Number 3." in got and "other stories" not in got and "Home" not in got
    outside = main_text(f"<body><article><h1>Title</h1>{body}</article>{links}<div class='{name}'><p>{PROSE}Outside.</p></div></body>")
    assert "Outside." not in outside and "other stories" not in outside


@pytest.mark.parametrize("name", ["notices", "promo", "comments", "advert", "cookie-banner", "newsletter"])
def test_named_boilerplate_goes(name):
    body = "".join(f"<p>{PROSE * 3}Number {i}.</p>" for i in range(4))
    assert "Inner." not in main_text(f"<article><h1>Title</h1>{body}<section class='{name}'><p>{PROSE * 2}Inner.</p></section></article>")


def test_math_and_label_text_stays():
    body = "".join(f"<p>{PROSE * 3}Number {i}.</p>" for i in range(4))
    got = main_text(f"<article>{body}<p>Let <math><mi>x</mi></math> be a <label>thing</label> that, as said before, is long enough here.</p></article>")
    assert "Let x be a thing that" in got


def test_long_lists_are_found_by_their_entries(spark, monkeypatch):
    """A token that each flush sees once only still has a long list, which is dealt out."""
    monkeypatch.setattr(jaccard, "LIST_ROWS", 5)
    monkeypatch.setattr(jaccard, "REPEATS", 40)
    rows = [(i, "rare alpha beta gamma delta " + " ".join(f"w{i}x{k}" for k in range(3 + i % 5))) for i in range(60)] + [(100 + i, "rare alpha beta gamma delta epsilon " + "same words here " * (i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in jaccard.join_components(df).collect()}
    assert got == {i: c for i, (_, c) in brute(dict(rows)).items()}


def test_lines_are_told_apart_by_two_hashes(spark, monkeypatch):
    """Lines whose first hash is the same stay two lines."""
    from pyspark.sql import functions as F

    first = F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else first(*c))
    rows = [(i, f"s{i}", "shared line\n" + f"own {i}") for i in range(12)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {(r.n_lines, r.n_removed, r.text) for r in got} == {(2, 1, f"own {i}") for i in range(12)}


def test_a_group_around_the_threshold_is_verified_by_few_pairs(spark, monkeypatch):
    """Copies of which some of the pairs link: components are exact, and the pairs verified grow with the copies, not with their square."""
    rng = np.random.RandomState(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(300):
        words = list(base)
        for at in rng.choice(14, 3, replace=False) * 14:
            words[at] = f"x{rng.randint(10**9)}"
        docs.append((i, " ".join(words)))
    asked = []
    answers = jaccard._answers
    monkeypatch.setattr(jaccard, "_answers", lambda pairs, *a: asked.append(pairs.distinct().count()) or answers(pairs, *a))
    got = {r.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(dict(docs)).items()}
    assert len(asked) > 1 and sum(asked[1:]) < 3 * len(docs), asked


def test_later_rounds_go_through_open_lists_only(spark, monkeypatch):
    """Lists in which no set has others left are settled by the first round; only the rest is dealt out again."""
    rng = np.random.RandomState(5)
    docs = {}
    for i in range(300):  # some of the pairs link: a set has more near ones than it asks for at first
        words = [f"w{k}" for k in range(200)]
        for at in rng.choice(14, 3, replace=False) * 14:
            words[at] = f"x{rng.randint(10**9)}"
        docs[i] = " ".join(words)
    for i in range(12):  # sets that share most tokens, but too few for a link
        docs[1000 + i] = " ".join([f"s{k}" for k in range(38)] + [f"u{i}x{k}" for k in range(6)])
    dealt = []
    tiles = jaccard._tiles

    def count(*args):
        out = tiles(*args)
        dealt.append({r.token for r in out.select("token").distinct().collect()})
        return out

    monkeypatch.setattr(jaccard, "_tiles", count)
    got = {r.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(docs).items()}
    assert len(dealt) > 1
    settled = set(next(jaccard._sets([docs[1000]])).view(np.int64).tolist())
    assert dealt[0] & settled and not any(x & settled for x in dealt[1:])


def test_unknown_chunks_take_no_python_call_each(monkeypatch):
    """op3: chunks are looked up and learned a batch at a time, also when the cache lets chunks go; the ids stay the library's."""
    monkeypatch.setattr(token_store, "CACHE", 3000)
    monkeypatch.setattr(token_store, "KEPT", 1000)
    enc = token_store.ChunkEncoder(tokenizer_path())
    texts = [" ".join(f"w{i * 37 % 911}é{j}\nB{j % 97}a.\nthe" for j in range(150)) for i in range(30)]
    calls, ids = 0, []

    def count(frame, event, _arg):  # of the module's own functions; a session's finalizers may run meanwhile
        nonlocal calls
        calls += event == "call" and frame.f_code.co_filename == token_store.__file__

    sys.setprofile(count)
    try:
        for lo in range(0, 30, 10):
            ids.append(enc.encode(pa.array(texts[lo : lo + 10])))
    finally:
        sys.setprofile(None)
    assert [n for _, size in ids for n in size.tolist()] == [len(enc.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert np.concatenate([x for x, _ in ids]).tolist() == [i for t in texts for i in enc.tok.encode(t, add_special_tokens=False).ids]
    assert len(enc.at) < 4500
    assert calls < 1500


def test_workers_let_go_of_what_the_token_stage_does_not_need(monkeypatch):
    """pipeline: other operators' caches go before the encoder is made, and the encoder before its files are read back."""
    other = {"cache": 1}
    monkeypatch.setattr(util, "_caches", [*util._caches, other.clear])
    monkeypatch.setattr(token_store, "ChunkEncoder", lambda path: path)
    token_store.encoder("a")
    assert not other and token_store._encoders == {"a": "a"}
    list(token_store._crc(iter([])))
    assert not token_store._encoders


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_dropped_caches_return_their_memory():
    """Small pieces freed among others that stay go back to the system."""
    code = """if True:
        from pagelake.llm import util
        mb = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096 >> 20
        kept = [bytes(1000) for _ in range(200_000)]
        held = kept[::20]
        before = mb()
        del kept
        util.drop_caches()
        print(before - mb())
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 50
