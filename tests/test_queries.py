"""Every registered query with checking SQL, run beside it."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, database

ORACLES = entry.oracle_sql()
FAST_MODELS = ["train_tree", "importance", "batch_score"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in ORACLES])
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, entry.queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", FAST_MODELS)
def test_model_query_returns_rows(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, entry.queries()[name], None) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
