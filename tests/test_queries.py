"""Every query against its SQL; learners are run and checked for shape."""

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries

LEARNERS = sorted(set(queries()) - set(oracle_sql()))


@pytest.fixture(scope="module")
def duck(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, data, duck, name):
    got = queries()[name](spark, data).toPandas()
    assert compare.differences(got, duck.execute(oracle_sql()[name]).df()) == []


@pytest.mark.parametrize("name", LEARNERS)
def test_learner_runs(spark, data, name):
    assert queries()[name](spark, data).count() > 0


def test_entry(spark):
    rows = entry(spark).toPandas()
    sums = rows.groupby("area")["percentage"].sum()
    assert ((sums - 100).abs() < 1e-3).all()


def test_no_unmatched_sql():
    assert set(oracle_sql()) <= set(queries())
