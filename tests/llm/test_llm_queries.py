"""Queries with SQL against it; the others run on the smallest tables."""

import pytest
from compare import by_sql, rows

from quillspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    if name in queries.SQL:
        assert rows(got) == rows(by_sql(small, queries.SQL[name]))
    elif name.endswith("_found"):
        assert len(got) and not got.duplicated().any()
