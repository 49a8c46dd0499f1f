"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

from __future__ import annotations

import pytest

from lumenarc.plans.queries import ORACLE, QUERIES
from tests.oracle import SF, connect, rows


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLE:
        want = con.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(got, df.columns) == rows(want.fetchall(), columns)
    else:
        assert got


def test_every_part_is_expanded(spark, con):
    df = QUERIES["JN_13_expand_every_term"](spark, SF)
    want = con.execute(ORACLE["JN_13_expand_term"].replace(" WHERE p_partkey % 100 = 0", ""))
    columns = [c[0] for c in want.description]
    got = df.collect()
    assert rows(got, df.columns) == rows(want.fetchall(), columns) and len(got) > 59


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
