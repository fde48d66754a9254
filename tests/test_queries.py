"""Registered queries against their SQL on the smallest driver tables."""

import os

import pytest
from check_queries import compare, duck

import __spark_entry__ as entry

FOLDER = os.environ.get("COREFOLD_TEST_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()
# The fitted models take most of the time and have tests of their own in
# test_models.py; COREFOLD_ALL_QUERIES=1 runs them here as well.
SOME_MODELS = {"em01", "em03", "em11", "em12", "em13", "em17", "em22", "em26", "em29", "em30", "em35"}
NAMES = sorted(
    n for n in entry.queries()
    if os.environ.get("COREFOLD_ALL_QUERIES") or not n.startswith("em") or n.split("_")[0] in SOME_MODELS
)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem, rows = compare(spark, con, name, entry.queries()[name], ORACLES.get(name), FOLDER)
    if problem == "no rows":
        pytest.skip("no rows at this scale")
    assert problem is None, problem
    spark.catalog.clearCache()


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
