"""Every registered query with a SQL oracle matches DuckDB on the sf0.001 tables;
the rest run and return rows (the driver repeats this at sf0.01)."""

import pytest

from causeway.plans.queries import ORACLES, QUERIES
from oracle import compare, duck

SLOW = {"text_baseline_embeddings"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    ok, msg = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["n", "ate_ipw", "ate_naive"] and df.count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
