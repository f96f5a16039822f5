"""Every registered query of the library's own operators runs, and equals its SQL where there is one."""

import pytest

from lodestar.plans.catalogue import ORACLES, QUERIES
from tests.compare import connection, rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
