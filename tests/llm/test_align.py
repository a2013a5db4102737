"""Cross-tokenizer alignment against a brute-force version, token by token."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.llm import align
from pagelake.llm.queries import op12_token_alignment, tokenizer_path

from ..oracle import SF
from .brute import byte_values


def brute(docs):
    """docs: [(doc_id, text)] -> rows of align.align, by whole texts and nested loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(tokenizer_path())
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    values, found, total = byte_values(), [], Counter()

    def b_raw(i):
        x = b_tok.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if b_tok.is_byte(i) else x.replace("▁", " ").encode()

    for doc_id, text in docs:
        a = [(i, bytes(values[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, b_raw(i)) for i in b_tok.encode(text)] if text else []
        want = b" " + text.encode() if text else b""
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a = b = []
        groups, links, at_a, at_b, i, j = [], [], 0, 0, 0, 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(a[i][1])
                left.append(a[i][0])
                i += 1
            else:
                at_b += len(b[j][1])
                right.append(b[j][0])
                j += 1
            if at_a == at_b:
                groups.append((left, right))
                links.append((left[-1], right[-1]))
                left, right = [], []
        total.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ODD = [
    None, "", " ", "  ", "\n", "a", " lead", "trail ", "two  spaces", "a\n\nb\tc", "x▁y", "▁", "a ▁b c", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00 \x1c\x1d a\x1f b", " hard space 　wide",
    "café é ퟿ \U0001f600 \U0001f468‍\U0001f469‍\U0001f467", "日本語の文", "it's we'll 'tis 12345 3.14 a_b", "end\r\nline\r\n", "word\u0085next   sep", "Don't  \n  stop", "trailing \n", "aaaa" * 400, "a b " * 3000,
]


@pytest.mark.parametrize("known", [1 << 18, 40, 0])
def test_odd_texts(spark, monkeypatch, known):
    """Nulls, empty and long texts, all kinds of white space, strings of special tokens, repeated rows; few or no pairs known beforehand."""
    monkeypatch.setattr(align, "MOST_KNOWN", known)
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)] + [(7, "same text"), (7, "same text")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, n_a int").repartition(3)
    assert got(align.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))) == brute(rows)


def test_documents(spark, monkeypatch):
    """All documents of the smallest table, with a cache that has to let chunks go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(op12_token_alignment(spark, SF)) == want


def test_cache_lets_chunks_go(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(align, "CACHE", 20)
    monkeypatch.setattr(align, "KEPT", 10)
    small, texts = align.Aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model")), [f"the {i} and {i * 7} word{i} the end" for i in range(60)]
    monkeypatch.undo()
    whole = align.Aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).align(pa.array(texts))
    monkeypatch.setattr(align, "CACHE", 20)
    monkeypatch.setattr(align, "KEPT", 10)
    for i, t in enumerate(texts):
        counts, hashes, _ = small.align(pa.array([t]))
        assert counts[0].tolist() == whole[0][i].tolist() and hashes[0] == whole[1][i]
    assert len(small.groups) <= 30


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string").withColumn("b", F.lit(1))
    assert got(align.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))) == []
