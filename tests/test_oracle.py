"""Every registered query against its SQL on the given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()
# filters without a match at the smallest scale
EMPTY = ("d04_traffic_anomaly", "d04_traffic_anomaly_per_session")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok or name in EMPTY and note.startswith("0 rows"), note


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 10 and rows[0].total_bytes >= rows[-1].total_bytes


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
