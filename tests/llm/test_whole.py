"""Operators lose nothing: the same answers for every way of cutting the work."""

import random
import time

import pytest

from pagelake.llm import decontaminate, html_extract


def test_slices_of_a_benchmark_score_as_all_of_it(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{min(int(rng.paretovariate(0.5)), 400)}" for _ in range(rng.choice((12, 30, 60))))) for i in range(60)]
    items.append((60, None))
    docs = []
    for i, t in items[:60]:
        w = t.split()
        docs.append((i, " ".join([f"x{k}" for k in range(40)] + w[: len(w) * 8 // 10] + [f"w{k}" for k in range(1, 30)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    data = spark.createDataFrame(docs, "doc_id long, text string")
    run = lambda n: {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.find_leaks(data, bench, threshold=0.5, overlap=0.1, max_items=n).collect()}
    whole = run(1000)
    assert len(whole) >= 30
    for n in (7, 25):
        cut = run(n)
        assert cut.keys() == whole.keys()
        assert all(cut[k] == pytest.approx(whole[k]) for k in whole)


PROSE = ["The river was high, and the bridge, which was old, had to be closed for the week.", "People walked round by the mill, through the fields, and over the other, newer bridge.", "In the end, after long rain, the water fell, and all was as it had been before."]
PARAS = "".join(f"<p>{x}</p>" for x in PROSE)
ALL = "\n\n".join(PROSE)
COMMENTS = "<div id=comments><ol class=commentlist><li><article class=comment-body><p>I liked this, really, very much, and so did my friends, all of them.</p></article></li></ol></div>"
SHARE = "<div class=share-links>Share this, please, with all of your friends, and their friends too.</div>"
SHELLS = {
    "has": f"<div class='content has-sidebar'><article>{PARAS}</article></div>", "no": f"<div class=no-comments>{PARAS}</div>", "with": f"<div class=with-side-menu><main>{PARAS}</main></div>",
    "form": f"<form action='/go'><input name=q><div>{PARAS}</div></form>", "wrapper": f"<div class=widget><article>{PARAS}</article></div>", "most": f"<div id=header><div>{PARAS}</div></div>",
    "nested": f"<form><div class='page banner'><article>{PARAS}</article>{COMMENTS}</div></form>",
    "section": f"<article><p>{PROSE[0]}</p><section id=discussion><p>{PROSE[1]}</p></section><p class=side>{PROSE[2]}</p></article>",
    "comments": f"<article>{PARAS}{COMMENTS}{SHARE}</article>", "after": f"<article>{PARAS}</article>{COMMENTS}", "box": f"<article>{PARAS}<form><p>Write your name here, and your address, and we will send you letters.</p></form></article>",
}


@pytest.mark.parametrize("name", sorted(SHELLS))
def test_names_do_not_cut_the_main_text(name):
    assert html_extract.main_text(f"<html><body><nav><a href=/>Home</a></nav>{SHELLS[name]}</body></html>") == ALL


HOSTILE = {
    "open": "<a ", "quote": "<a b=\"", "mixed": "<a b='x' c", "end": "</a ", "cdata": "<![CDATA[", "comment": "<!--", "closed": "<div>x</span>", "rows": "<ul><span><li>x</li>", "heads": "<span><h2>x</h2>", "entity": "&amp", "script": "<script>", "turn": "<a b=\"'\" c='\"'",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_grows_with_the_page(name):
    """A megabyte of one kind of broken markup takes seconds, and the article before it is found."""
    piece = HOSTILE[name]
    began = time.time()
    text = html_extract.main_text(f"<html><body><article>{PARAS}</article>" + piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20
    assert text.startswith(ALL)


def test_markup_by_quotes():
    assert html_extract.main_text(f"<body><article class='a>b' title=\"x > y\">{PARAS}</article >") == ALL
    assert html_extract.main_text("<p>Say 1 < 2, and <b x='>'>that</b> is <![CDATA[a & <b>]]> end<!-- > --> of it</p>") == "Say 1 < 2, and that is a & <b> end of it"
