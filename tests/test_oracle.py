"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import pytest

from threadline.plans import catalog
from tools.compare import check, connect

# Variants without a twin whose loops are long; the comparison tool runs them at every scale.
SLOW = {"communities_brands", "betweenness_brands"}


@pytest.fixture(scope="module")
def link(data):
    return connect(data)


@pytest.mark.parametrize("name", [name for name in catalog.all_queries() if name not in SLOW])
def test_query(spark, link, data, name):
    status, _, note = check(spark, link, data, name)
    assert status in ("ok", "ROWS-ONLY"), note


def test_every_twin_has_a_query():
    assert set(catalog.all_sql()) <= set(catalog.all_queries())
