"""Every query against its SQL twin."""

import pytest

from docattr import catalog
from docattr.catalog import check, registry

catalog.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_agrees_with_sql(name, spark, con, sf_dir):
    assert check.compare(spark, con, name, sf_dir) is None


def test_every_query_has_sql():
    assert sorted(set(registry.QUERIES) - set(registry.SQL)) == []
