"""Licence scan: against SQL on odd rows, and against counting every template in every block."""

import re

import duckdb
import pytest

from pagelake.llm import licenses
from pagelake.llm.licenses import TEMPLATES, Template

from ..oracle import rows as normal

MIT, GPL = TEMPLATES[0].text, TEMPLATES[4].text
TEXTS = [
    None, "", " \n ", "MIT license", "the MIT-License and mit license, Apache License; GNU General Public License", "general public", "general\tpublic\tLICENSE general public license",
    "İMIT LICENSE mit lICENSE", "mit  licenses", "license", MIT, MIT.upper(), f"{'word ' * 700}{MIT}{' word' * 9000}{GPL}", " ".join(reversed(GPL.split())), MIT.replace("merge", "").replace("sell", ""),
    " ".join(MIT.split()[:40]), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0 by someone", f"{'a ' * 15}Released under{' the' * 12} MIT License", "Released under" + " x" * 40 + " the MIT License",
    "Licensed under the Mozilla Public License, Version 2.0", "\x00mit\x00license\x00", "été mit license日本 mit licenseé", "Released under the MIT License.", "Released under the MIT License.",
]


def got(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def from_sql(rows, **how):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    res = con.execute(licenses.scan_sql(**how))
    return normal([c[0] for c in res.description], res.fetchall())


@pytest.mark.parametrize("how", [{}, {"templates": (Template("x", "one two three four five six seven eight", 0.5), Template("y", "mit license of one", 0.75))}, {"phrases": (("license", "l"), ("the mit license", "m"))}])
def test_odd_rows(spark, how):
    """Nulls, empty and long texts, repeated rows, rows without an id, extra columns with clashing names."""
    rows = [(i if i % 4 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, "x", [1], 2.0) for r in rows], "doc_id long, text string, label string, words array<int>, score double").repartition(3)
    assert got(licenses.scan(docs, **how)) == from_sql(rows, **how)


def test_every_block(spark):
    """Each template against each block by plain sets; the filters may lose none."""
    rows = [(i, t or "") for i, t in enumerate(TEXTS)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=(("no such phrase", "none"),)).collect()}
    for i, text in rows:
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        labels, best = set(), 0.0
        for t in TEMPLATES:
            own = set(t.words())
            for lo in range(0, max(len(words), 1), t.width() // 2):
                shared = len(own & set(words[lo : lo + t.width()]))
                if shared >= t.least * len(own) - 1e-9:
                    labels.add(t.label)
                    best = max(best, shared / len(own))
        assert (found[i].labels, found[i].score, found[i].n_words) == (",".join(sorted(labels)), best, len(words))


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_template_in_one_piece_is_always_found(spark):
    rows = [(n, "x " * n + GPL + " y" * 50) for n in range(0, 300, 7)]
    assert all("gpl" in r.labels and r.score == 1.0 for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=()).collect())


def test_no_python_on_executors(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
