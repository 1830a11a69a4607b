"""Every query with SQL behind it returns the same rows as DuckDB."""

import oracle
import pytest

from assayline.plans import catalogue

ORACLES = catalogue.oracles()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def duck(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, folder, name):
    rows, difference = oracle.compare(spark, duck, QUERIES[name], ORACLES[name], folder)
    assert difference is None
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
