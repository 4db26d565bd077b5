import pytest

from oracle import compare
from tidegate.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01" if name.startswith(("p7", "p8")) else "/root/testdata/sf0.001"
    assert compare(spark, folder, catalog.QUERIES[name], catalog.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
