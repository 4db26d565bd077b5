import pytest

from oracle import compare
from tidegate.plans import catalog

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"  # for models and searches, at their full settings


@pytest.mark.parametrize("name", sorted(n for n in catalog.SQL if not n.startswith("p1_")))
def test_against_sql(spark, name):
    assert compare(spark, DATA, catalog.QUERIES[name], catalog.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL).collect()
    assert rows and len({str(r) for r in rows}) == len(rows)


def test_flagship(spark):
    assert catalog.flagship(spark, SMALL).count() > 0
