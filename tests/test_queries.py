"""Every registered query against its SQL counterpart on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from hearthstat.plans.oracle import ORACLE_SQL as ORACLE
from hearthstat.plans.queries import QUERIES
from hearthstat.sources.house import SCHEMAS
from hearthstat.sources.stored import stored_tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")



@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in SCHEMAS:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return c


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    with stored_tables(spark):
        _compare(QUERIES[name](spark, SF_DIR), con.execute(ORACLE[name]))


def _compare(df, relation):
    names = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in relation.fetchall()), key=repr)
    assert got and got == want


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 10
    for country in ("AT", "DE"):
        assert sum(r.proportion for r in rows if r.sa0100 == country) == pytest.approx(1)


def test_gross_income_two_ways(spark):
    df = QUERIES["income_aggregates"](spark, SF_DIR)
    assert df.where("abs(income_psid - total_gross_income) > 1e-6").isEmpty()
    assert not df.where("total_gross_income = 0").isEmpty()


@pytest.mark.parametrize("name", ["weighted_distribution", "change_summary", "corr_panel", "box_stats_group", "kde_networth"])
def test_plans(spark, name):
    """No row-wise Python, no Cartesian product, no gathering percentile, and pruned, filtered scans."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "CartesianProduct", "percentile", "l_shipdate"):
        assert bad not in plan


SINGLE_PASS = [
    "weighted_distribution", "weighted_distribution_by_year", "weighted_table_by_implicate", "replicate_variance_share",
    "null_profile", "crosstab_counts", "acquisition_counts", "corr_panel", "corr_test_panel", "lm_band_limited",
    "ols_consumption", "iv_consumption_price", "bin2d_change_assets",
]


@pytest.mark.parametrize("name", SINGLE_PASS)
def test_single_pass(spark, name):
    """These read the large table once."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
