"""Every registered query against its SQL twin."""

import __spark_entry__ as contract
import pytest
from check_queries import compare, oracle

NAMES = sorted(contract.queries())


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, sf_dir, name):
    assert compare(spark, connection, sf_dir, name) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert 0 < len(rows) <= 30
    assert rows[0].asDict().keys() == {"src_ip", "flows", "mean_spike_score"}


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(NAMES)
