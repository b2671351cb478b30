"""The dealt text and vector queries on the smallest tables."""

import pytest
from compare import same

from chronolens.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE:
        same(df, duck, catalog.ORACLE[name])
    else:
        assert df.columns and df.count() > 0
