"""Every query of the subpackage runs on the smallest tables; those with SQL give the rows that DuckDB gives."""

import pytest
from compare import same_rows

from loomgraph.llm.registry import QUERIES, SQL


#: On the smallest tables no passage stands in a text with other slots.
MAY_BE_EMPTY = {"p8_reparameterised"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.count() > 0 or name in MAY_BE_EMPTY
