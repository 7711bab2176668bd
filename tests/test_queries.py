"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import pytest
from compare import same

from lodestone.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() == 10
