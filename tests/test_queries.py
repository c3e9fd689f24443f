"""Every bound query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

from .compare import rows_equal

SF = os.environ.get("ATLAS_TEST_SF", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    same, why = rows_equal(got, duck.sql(sql).to_arrow_table())
    assert same, why


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
