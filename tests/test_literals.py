"""The operators over small tables written out here, against SQL or the result itself."""

import pytest

from . import literal_market, literal_service, literal_site
from .oracle import check

CASES = [(m, n) for m in (literal_market, literal_service, literal_site) for n in sorted(m.QUERIES)]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_small_tables(spark, module, name):
    check(spark, module.QUERIES[name], module.ORACLE_SQL[name])
