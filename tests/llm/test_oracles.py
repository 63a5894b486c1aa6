import pytest

from rillwork.llm.queries import ORACLE, QUERIES

from compare import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE[name], sf)
