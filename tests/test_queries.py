"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import pytest

from marlstone.plans import registry
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf_dir, connection, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), connection, registry.ORACLE[name]) == []


def test_training_learns(spark, sf_dir):
    rows = registry.QUERIES["sgd_round"](spark, sf_dir).collect()
    assert rows and all(0 <= r.accuracy <= 1 and r.loss > 0 and r.low <= r.high for r in rows)


def test_entry_has_every_oracle_among_its_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
    assert registry.FLAGSHIP in registry.QUERIES
