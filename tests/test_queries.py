"""Every registered query against its SQL equivalent, on the smallest tables."""
from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle_check import connect, difference

from tidegraph.queries import QUERIES, SQL

# these set a session option while they run
STREAMS = {"recent_neighbors_state", "recent_neighbors_at", "node_state_stream"}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def results(spark, sf):
    """Futures of all query results; the queries are small, so several run at a time."""
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(lambda fn=fn: fn(spark, sf).toPandas())
               for name, fn in sorted(QUERIES.items()) if name not in STREAMS}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_query(results, duck, name):
    got = results[name].result()
    if name in SQL:
        assert difference(got, duck.sql(SQL[name]).df()) is None
    assert len(got) > 0


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_stream_query(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
