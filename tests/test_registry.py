"""Every registered query against its SQL oracle on the smallest driver tables."""

import os

import pytest

from tools.check_oracles import TABLES, digest_rows

SF = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402

# queries without SQL are tested where their operators are
NAMES = sorted(n for n in entry.queries() if n in entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql()[name]
    res = duck.execute(sql)
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert digest_rows(df.columns, rows)[0] == digest_rows(ocols, res.fetchall())[0]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"consumer_id", "group_id", "estimated_tokens"} <= set(df.columns)
    assert {r.consumer_id for r in df.collect()} == {"alpha", "beta"}


def test_every_core_query_has_an_oracle():
    from threadloom.plans import registry
    assert set(registry.QUERIES) == set(registry.ORACLES)
