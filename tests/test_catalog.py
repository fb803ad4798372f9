"""Every query against its SQL, over the whole of the two smaller test data sets."""

import pytest

import __spark_entry__ as entry
import oracle
from quire.plans import catalog

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module", params=[SMALL, MEDIUM])
def data(request):
    return request.param, oracle.connect(request.param)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    sf, db = data
    same, more, less = oracle.compare(catalog.queries()[name](spark, sf), db, SQL[name])
    assert same and not more and not less, (list(more)[:3], list(less)[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["book_slug", "section_pos", "words", "ratio", "target_words", "pct"] and df.count() > 0
