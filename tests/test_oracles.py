"""Every query of the library that has SQL agrees with DuckDB; the others run."""

import pytest
from oracle import difference

from siltstone import plans
from siltstone.plans import catalog  # noqa: F401


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_agrees_with_sql(spark, sf, name):
    assert difference(plans.QUERIES[name](spark, sf), sf, plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.columns
    df.collect()
