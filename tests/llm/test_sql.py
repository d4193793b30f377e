"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest

from hearthstat.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    relation = con.execute(ORACLE_SQL[name])
    assert df.columns == [d[0] for d in relation.description]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(relation.fetchall(), key=repr)


def test_one_query_for_each_operator():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
