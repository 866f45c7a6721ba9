"""Every registered query of the library's own operators: against its SQL where there is one, else that it runs and keeps its columns."""

import pytest
from compare import same

from tideline.plans.queries import ORACLE, QUERIES

SLOW = {"purged_model_folds"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys() - SLOW))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() > 0


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
