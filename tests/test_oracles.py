"""Every registered query against its SQL. Derived tables are shared to save time."""

import pytest

from catalog.oracles import ORACLES
from catalog.queries import ON_TABLES, QUERIES
from catalog.views import Tables
from tests.compare import connect, difference

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ON_TABLES))
def test_query_matches_sql(name, tables, con):
    df = ON_TABLES[name](tables)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0
