"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from pagelake.plans.registry import ORACLE_SQL, QUERIES

from .oracle import SF, check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.collect()


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_engine_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "pagelake"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "pagelake.llm" not in f.read_text() and "from .llm" not in f.read_text(), f
