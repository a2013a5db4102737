"""Token files, mixing, decontamination, secrets, lines, languages and HTML, on small tables and odd rows."""

import hashlib
import time
import zlib

import duckdb
import pytest

from pagelake.llm import decontaminate, html_extract, langid, line_dedup, mixing, secrets, token_store
from pagelake.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from ..oracle import SF, check, rows

DDL = "doc_id long, text string, source string, lang string, size long, kinds string, h long, part int"


def frame(spark, data):
    return spark.createDataFrame([(d, t, s, lang, 1, "k", 2, 3) for d, t, s, lang in data], DDL)


def in_duckdb(data, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if data:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in data])
    res = con.execute(sql)
    return [c[0] for c in res.description], res.fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


ODD = [(1, None, "a", "en"), (2, "", "a", "en"), (3, "x\ny\nx", None, None), (3, "x\ny\nx", None, None), (4, "line\n line \nother", "b", "de"), (None, "x\nz", "c", "fr"), (5, "long " * 3000, "a", "en")]


def test_line_dedup_odd_rows(spark):
    got = line_dedup.dedup(frame(spark, ODD), min_sites=1).collect()
    assert len(got) == len(ODD)
    assert all(r.text is None and r.n_lines == 0 for r in got if r.doc_id == 1)
    spread = [(i, "common\nown %d" % i, f"s{i % 12}", "en") for i in range(40)]
    got = line_dedup.dedup(frame(spark, spread), min_sites=12).collect()
    assert {r.text for r in got} == {"own %d" % i for i in range(40)}
    assert line_dedup.dedup(frame(spark, [])).collect() == []


SECRETS = [
    (1, 'Password = "hunter22!" token: abc  api-key=zz api_key:  =x1234567', "a", ""), (2, "token=token: abcdef", "a", ""), (3, "é😀 AKIA" + "Z9" * 8 + " AKIAshort " + "0123456789abcdef" * 2, "a", ""), (3, "secret:abcdef", "a", ""),
    (4, None, "a", ""), (5, "", "a", ""), (6, "ſecret=abcdefgh PASSWD='Abc/+=._-' toKen=a=b=c=d", "a", ""), (7, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 40 + " AIza" + "b" * 35, "a", ""), (None, "apikey=abcdef", "a", ""), (8, "deadbeef" * 3 + "x" + "abc" * 7, "a", ""),
]


def test_secrets(spark):
    df = secrets.scan(frame(spark, SECRETS))
    cols, want = in_duckdb(SECRETS, secrets.scan_sql())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, want)
    many = [(1, "0123456789abcdef" * 2 + " password=hunter22 ", "", ""), (2, ("0123456789abcdef" * 2 + " é ") * 20_000 + "token=abcdefgh", "", "")]
    began = time.time()
    two = {r.doc_id: r for r in secrets.scan(frame(spark, many)).collect()}
    assert time.time() - began < 30 and two[2].n_hex == 20_000 and two[2].n_assign == 1
    starts = [int(x.split(":")[1]) for x in two[2].spans.split(",")]
    assert starts == [35 * i for i in range(20_001)]
    one = {r.doc_id: r for r in df.where("doc_id in (2, 6)").collect()}
    assert one[2].n_assign == 0 and one[6].n_assign == 2
    assert secrets.scan(frame(spark, [])).collect() == []


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("(abcd|xyz)q?") == [["abc", "bcd"], ["xyz"]]


def test_mixing(spark, monkeypatch):
    data = [(i, "w " * (i % 17 + 1), f"s{i % 5}" if i % 7 else None, "en") for i in range(300)] + [(900, None, "s1", "en"), (901, "", "zero", "en"), (902, "big " * 4000, "s9", "en"), (903, "two words", "s0", "en")]
    got = mixing.mix(frame(spark, data)).select("doc_id", "size", "source_size", "target", "taken")
    cols, want = in_duckdb(data, mixing.mix_sql())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(cols, want)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    lost = data + [(None, "w " * (i % 23), f"s{i % 3}", "en") for i in range(80)]
    got = mixing.mix(frame(spark, lost)).select("doc_id", "size", "source_size", "target", "taken")
    cols, want = in_duckdb(lost, mixing.mix_sql())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(cols, want)
    per = {}
    for r in mixing.mix(frame(spark, data)).collect():
        assert 0 <= r.taken <= 2 * r.size
        per.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in per.items())
    assert mixing.mix(frame(spark, [])).collect() == []


def test_applied_mix_has_the_words_taken(spark):
    data = [(i, " ".join(f"d{i}w{k}" for k in range(i + 1)), f"s{i % 3}", "en") for i in range(20)] + [(3, "same id", "s1", "en"), (None, "no id", "s0", "en")]
    docs = frame(spark, data)
    mixed = mixing.mix(docs)
    out = mixing.apply_mix(docs, mixing.mix_plan(docs)).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixed.collect())
    want, have = {}, {}
    for r in mixed.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for r in out:
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.split())
    assert have == {d: n for d, n in want.items() if n}
    same = frame(spark, [(i // 9, "five words are in here", f"s{i % 2}", "en") for i in range(40)] + [(None, "no id", "s0", "en")] * 5)
    again = mixing.apply_mix(same, mixing.mix_plan(same)).collect()
    assert sum(len(r.text.split()) for r in again) == sum(r.taken for r in mixing.mix(same).collect())
    assert all(any(t is not None and t.startswith(r.text) for _, t, _, _ in data) for r in out)


TEXTS = ["It's 123 fine.\nNew line", "  lead", "tab\there", "a  b", "trail ", "\n\n", "é😀 <|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>", "<|end", "", None, "x\x00y z", "nbsp here we go", "word " * 5000]


def test_token_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    data = [(i * 7 % 15, t, "a", "en") for i, t in enumerate(TEXTS)] + [(3, "again", "a", "en"), (3, "again", "a", "en")]
    got = sorted(token_store.round_trip(frame(spark, data), tokenizer_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _, _, _ in data)
    at, want = 0, {}
    for d, t, _, _ in data:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    have = {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {d: sorted(v) for d, v in have.items()} == {d: sorted(v) for d, v in want.items()}
    assert token_store.round_trip(frame(spark, []), tokenizer_path()).collect() == []


def test_decontamination(spark):
    items = [(1, "What is the capital of Freedonia in spring? It is the town of Quux."), (2, "Name three rivers that flow north through wide valleys and deep green forests."), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pad = "the of is and what it a in to common filler words here " * 40
    data = [(1, pad + items[0][1] + pad, "", ""), (2, items[1][1].upper().replace(" ", ", "), "", ""), (3, pad, "", ""), (4, "What is the capital of Freedonia in spring?", "", ""), (5, None, "", ""), (6, "", "", ""), (1, items[1][1], "", "")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, data), bench).collect()}
    assert got == {(1, 1), (2, 2), (1, 2)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, data), bench, max_items=1).collect()} == got
    assert decontaminate.find_leaks(frame(spark, data), bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(frame(spark, []), bench).collect() == []


def test_decontamination_query_against_brute_force(spark):
    from .brute import leaks

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    want = leaks(docs, items, decontaminate.question_answer)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and want


def test_language_query_against_brute_force(spark):
    from .brute import languages

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = languages(learned, {r.doc_id: r.text for r in rows})
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op9_language_id"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and got[d][1] == pytest.approx(want[d][1]) for d in want)


def test_wand_finds_all_above_the_threshold(monkeypatch):
    import random

    r = random.Random(5)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 12)))) for i in range(50)]
    for dense in (1 << 24, 0):
        monkeypatch.setattr(decontaminate, "DENSE", dense)
        ix = decontaminate.ItemIndex(items)
        for _ in range(50):
            import numpy as np

            terms = np.array(sorted({ix.term[w] for w in r.sample(vocab, 25) if w in ix.term}))
            plain = {}
            for t in terms:
                for k, v in zip(ix.docs[t].tolist(), ix.impact[t].tolist(), strict=True):
                    plain[k] = plain.get(k, 0) + v
            assert {k for k, _ in ix.search(terms, 0.5)} == {k for k, v in plain.items() if v >= 0.5 - 1e-9}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d in got if got[d].held_out} == set(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_of_other_scripts(spark):
    """Letters beyond the basic plane's start are told apart; columns named like the result's do not matter."""
    data = [(1, "ўсе словы мовы", "", "be", 1.0, "x"), (2, "all of the words", "", "en", 1.0, "x"), (3, "日本語の文", "", "ja", 1.0, "x"), (4, "中文的句子", "", "zh", 1.0, "x"), (5, "long words of all " * 20_000, "", None, 1.0, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, score double, lang_pred string")
    p = langid.learn_profiles(docs)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, p).collect()} == {1: "be", 2: "en", 3: "ja", 4: "zh", 5: "en"}
    assert [r["count"] for r in p.groupBy("lang").count().collect()] and p.where("gram < 0").count() == 0


def test_language_id_odd_rows(spark):
    data = [(1, "the cat and the dog", "a", "en"), (2, "der hund und die katze", "a", "de"), (3, None, "a", "en"), (4, "123 !?", "a", "en"), (5, "the the", "a", None), (None, "und die", "a", "de")]
    p = langid.learn_profiles(frame(spark, data))
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, data), p).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "en", None: "de"}
    assert {r.lang_pred for r in langid.identify(frame(spark, data), p.limit(0)).collect()} == {"und"}
    assert langid.identify(frame(spark, []), p).collect() == []


ART = "<h1>Head</h1><p>First &amp; best, with some words, of the article text here.</p><p>Second part <b>bold</b>\n here, and more<br>to read, of it all.</p><p>Short.</p>"
WANT = "Head\n\nFirst & best, with some words, of the article text here.\n\nSecond part bold here, and more to read, of it all.\n\nShort."
PAGES = {
    "article": f"<html><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><div class='ad'>Buy, buy, buy this now, it is very good for you.</div><article>{ART}</article><footer>Foot, with commas, and text, and more text.</footer></body></html>",
    "div": f"<body><div id=header>Site, the best, of all sites in the whole world</div><div id=content>{ART}</div><div class=sidebar><p>Some other text, with commas, and more, and more words here.</p></div><div id=comments><p>A reader says, at length, that this was very, very good.</p></div></body>",
    "body": f"<body><header><p>Welcome, dear reader, to this fine site of ours.</p></header>{ART}<form><p>Sign up, now, please, for our letter, it is free.</p></form><script>var t='</p>, x';</script></body>",
    "main": f"<main><div><div>{ART}</div></div><aside>Other, things, to, read, are here for you.</aside></main>",
    "unclosed": f"<body><div class=cookie-notice>We use cookies, and, more, and so on, and so forth.</div><article>{ART}",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_extract.main_text(PAGES[name]) == WANT


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGES["article"], "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "plain text only", "x"), (4, "u", "plain text only", "x"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert got == {1: (WANT, len(WANT)), 2: ("", 0), 3: ("", 0), 4: ("plain text only", 15), 5: ("deep", 4)}
    assert html_extract.extract(df.limit(0)).collect() == []
    clash = spark.createDataFrame([(1, "u", PAGES["main"], 9, "t"), (None, None, "long " * 200_000, 9, "t")], "page_id long, url string, html string, n_chars int, text string")
    assert {r.page_id: r.n_chars for r in html_extract.extract(clash).collect()} == {1: len(WANT), None: 999_999}


def test_pages_of_the_test_data(spark):
    """On these pages the article element is the main text: compare with it, tags taken off."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        art = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", art)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
