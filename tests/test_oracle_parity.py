"""Every registered query equals its DuckDB oracle (sf0.001)."""

import pytest

from runlens.plans import registry
from tests.conftest import SMOKE

registry.load_all()


@pytest.fixture(scope="module")
def con():
    from runlens.plans.check import duck
    return duck(SMOKE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    from runlens.plans.check import compare
    r = compare(spark, SMOKE, name, con)
    if name in registry.ORACLE:
        assert r["columns_match"], r
        assert r["match"], r
    else:
        assert r["rows"] >= 0


def test_every_query_has_an_oracle():
    missing = sorted(set(registry.QUERIES) - set(registry.ORACLE))
    assert missing == [], missing


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(registry.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
