"""Every query of the core runs on the smallest tables; those with SQL give the rows that DuckDB gives."""

import pytest
from compare import same_rows

from loomgraph.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
