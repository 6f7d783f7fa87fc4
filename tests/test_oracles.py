"""Every registered query at the smallest scale next to its oracle SQL."""

import os

import pytest

import compare
from lexframe.plans.registry import all_oracles, all_queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    return compare.duck(SF_DIR)


def test_every_oracle_belongs_to_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_oracle(spark, duck, name):
    fn, sql = all_queries()[name], all_oracles().get(name)
    df = fn(spark, SF_DIR)
    columns, mine = compare.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        assert mine
        return
    cursor = duck.execute(sql)
    want_columns, want = compare.rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == want_columns
    assert mine == want
