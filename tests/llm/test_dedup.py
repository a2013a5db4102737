"""Substring dedup, Jaccard join and embeddings against plain versions, and on odd rows."""

import random

import numpy as np
import pytest

from pagelake.llm import embed_dedup, jaccard, substring_dedup
from pagelake.llm.components import components

from .brute import Union
from .brute import jaccard as plain_jaccard
from .brute import substring_dedup as plain_substring

DDL = "doc_id long, text string, n long, cls long, rep long, component_id string"


def corpus(seed=1, n=120):
    """Documents with copies, near copies, a shared passage, a periodic text and odd rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    passage = text(70)
    docs = {}
    for d in range(n):
        w = text(r.choice([3, 20, 60, 200]))
        kind = r.random()
        if docs and kind < 0.15:
            w = docs[r.choice(list(docs))].split()
        elif docs and kind < 0.4:
            w = docs[r.choice(list(docs))].split()
            for _ in range(max(1, len(w) // 60)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.6:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        elif kind < 0.65:
            w = ["la", "LA"] * r.choice([30, 60])
        docs[d * 3 + 1] = r.choice([" ", "\n", " \t"]).join(w)
    return docs


def frame(spark, docs, more=()):
    return spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in [*docs.items(), *more]], DDL)


@pytest.mark.parametrize("group_rows", [4000, 2])
def test_substring_dedup(spark, monkeypatch, group_rows):
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", group_rows)
    docs = corpus()
    docs[1000], docs[1001] = None, ""
    docs[1002] = "long " * 40_000 + docs[1]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, docs)).collect()}
    assert got == plain_substring(docs)


def test_suffix_array():
    r = np.random.RandomState(2)
    for depth in (3, 8, 21):
        w = r.randint(0, 3, 400).astype(np.uint64)
        starts = np.arange(len(w) - depth + 1)
        order, common = substring_dedup.suffix_array(w, starts, depth)
        sorted_ = [tuple(w[s : s + depth]) for s in starts[order]]
        names = np.unique(w, return_inverse=True)[1]
        assert sorted_ == sorted(tuple(w[s : s + depth]) for s in starts) and len(names) == len(w)
        for k in range(1, len(order)):
            a, b = sorted_[k - 1], sorted_[k]
            assert common[k] == next((i for i in range(depth) if a[i] != b[i]), depth)
        node = substring_dedup.deep_nodes(w, starts, depth)
        assert len({(n, tuple(w[s : s + depth])) for n, s in zip(node, starts, strict=True)}) == len(set(node)) == len(set(sorted_))


def test_substring_dedup_odd_rows(spark):
    t = " ".join(f"x{i}" for i in range(80))
    rows = substring_dedup.dedup(frame(spark, {1: t}, [(1, t), (None, t), (2, t + " y"), (3, "é " * 60)]), with_text=True).collect()
    assert len(rows) == 5
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0, 0]
    assert [r.n_removed for r in rows if r.doc_id is None] == [0]
    two = next(r for r in rows if r.doc_id == 2)
    assert two.n_removed == 80 and two.kept_text == "y" and [tuple(s) for s in two.spans] == [(0, 80)]
    assert substring_dedup.dedup(frame(spark, {})).collect() == []


@pytest.mark.parametrize(("short", "frequent", "rows"), [(6, 1 << 18, 20_000), (2, 40, 5), (2, 0, 20_000)])
def test_jaccard(spark, monkeypatch, short, frequent, rows):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "LIST_ROWS", rows)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 7 if rows == 5 else 4096)
    monkeypatch.setattr(jaccard.frequent_tokens, "__defaults__", (frequent,))
    docs = corpus(2)
    docs[1000], docs[1001], docs[1002] = None, "", "A b"
    docs[1003] = "a B"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame(spark, docs)).collect()}
    assert got == plain_jaccard(docs)


def test_jaccard_odd_rows(spark):
    rows = jaccard.join_components(frame(spark, {5: "a b c d e f"}, [(5, "a b c d e f"), (None, "a b c d e f"), (7, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 5), (5, 5), (5, 5), (7, 7)]
    assert jaccard.join_components(frame(spark, {})).collect() == []
    near, far = " ".join(f"n{i}" for i in range(60)), " ".join(f"m{i}" for i in range(60))
    data = [(5, near), (None, near), (None, near + " x"), (None, far), (None, far + " y"), (9, "long " * 30_000 + near), (8, "LONG " * 30_000 + near)]
    rows = jaccard.join_components(frame(spark, {}, data)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (0, 5), (0, 5), (5, 5), (8, 5), (9, 5)]


def test_jaccard_classes_of_one_hash(spark, monkeypatch):
    """Sets whose first hash agrees stay apart by their second."""
    plain, sets = jaccard._hashes, jaccard._sets
    weak = lambda s: (plain(s)[0] % 5, plain(s)[1]) if len(s) else (0, 0)
    monkeypatch.setattr(jaccard, "_hashes", weak)
    monkeypatch.setattr(jaccard, "_classes", lambda texts: [weak(s) for s in sets(texts)])
    docs = corpus(4, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame(spark, docs)).collect()}
    assert got == plain_jaccard(docs)


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize(("cell", "block"), [(1024, 1024), (16, 1024), (32, 20)])
def test_embeddings(spark, cell, block):
    r = np.random.RandomState(3)
    x = r.standard_normal((400, 32))
    x[100:160] = x[5] + 0.05 * r.standard_normal((60, 32))
    x[160:170] = x[6]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(10, 410))
    rows = [(i, [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)]
    rows += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [1.0, None], 1), (1004, [float("inf")] * 32, 1), (1005, [], 1)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), cell_rows=cell, block_rows=block).collect()}
    cos = x @ x.T
    u = Union(ids)
    for i, j in zip(*np.nonzero(np.triu(cos >= 0.95, 1)), strict=True):
        u.join(ids[i], ids[j])
    want = (cos >= 0.95).sum(axis=1) - 1
    have = np.array([got[i].n_links for i in ids])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert all(got[i].component_id == u.find(i) and got[i].kept == (u.find(i) == i) for i in ids)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006))


def test_collisions_are_those_of_the_windows():
    r = np.random.RandomState(5)
    p, q = r.standard_normal((50, 6)), r.standard_normal((70, 6))
    for least in (0, 2, 5):
        i, j = embed_dedup.collide(p, q, 0.7, least)
        want = (np.abs(p[:, None] - q[None]) <= 0.7).sum(axis=2) >= least
        assert sorted(zip(i, j, strict=True)) == sorted(zip(*np.nonzero(want), strict=True))
        i, j = embed_dedup.collide(p, None, 0.7, least)
        want = np.triu((np.abs(p[:, None] - p[None]) <= 0.7).sum(axis=2) >= least, 1)
        assert sorted(zip(i, j, strict=True)) == sorted(zip(*np.nonzero(want), strict=True))


def test_recall_at_the_threshold(spark):
    """Pairs of a cosine just over the threshold among unrelated vectors, in small cells: the hardest case."""
    r = np.random.RandomState(9)
    x = r.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = embed_dedup.partners(x[:1500], 0.951)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, y)))]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=64).collect()}
    assert sum(got[3000 + i].component_id == i for i in range(1500)) >= 0.95 * 1500
    assert all(got[i].n_links == 0 for i in range(1500, 3000))


def test_embeddings_of_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 1.0, 0.0]
    rows = [(1, v), (1, v), (1, w), (None, v), (None, None), (2, [2.0, 0.0, 0.0, 0.4]), (3, w)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == [(0, 0, None, False), (0, 0, None, False), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_no_embeddings(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_links_between_leaders_are_few(spark):
    """Of the links of a group only those stay that connect it: not each set with each of its leaders."""
    from pagelake.llm.components import components
    from pagelake.llm.jaccard import _spanning

    dense = [(a, b) for a in range(20) for b in range(20, 400)] + [(500, 501), (501, 502), (7, 503), (503, 504)]
    links = spark.createDataFrame(dense, "a long, b long")
    few = _spanning(links).collect()
    assert len(few) < 450
    assert sorted(components(_spanning(links)).collect()) == sorted(components(links).collect())
