"""Every registered query with a SQL twin gives the twin's rows."""

import pytest
from compare import duck, mismatch
from conftest import SMALL

from creditloom.queries import all_oracles, all_queries, models

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_twin_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, con, name, monkeypatch):
    for rounds in ("SEARCH_ROUNDS", "SCREENING_ROUNDS"):  # what is compared does not depend on them
        monkeypatch.setattr(models, rounds, 1)
    assert mismatch(spark, con, QUERIES[name], ORACLES[name], SMALL) is None
