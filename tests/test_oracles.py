"""Every registered query of the engine against its DuckDB counterpart, on whole tables."""

import pytest
from compare import database, differences

from pairlens import plans
from pairlens.plans import registry

plans.load()


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, db):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert differences(df, db, registry.ORACLES[name]) == ""
    else:
        assert df.count() > 0
