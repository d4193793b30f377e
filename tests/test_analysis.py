"""The whole way from input tables with mixed spellings to the weighted distribution."""

import pytest

from hearthstat.operators import prep, survey
from hearthstat.plans import analysis
from hearthstat.plans.variables import CHANGE_LEVELS

KEYS = "survey int, Sa0010 int, sa0100 string, im0100 int"
INCOMES = ["DI1100", "DI1200", "DI1300", "DI1400", "DI1420", "DI1500", "DI1600", "DI1700"]


@pytest.fixture(scope="module")
def tables(spark):
    # Household i of a country; implicate 2 of household 2 has no known value.
    homes = [(1, "AT", 100.0, 250.0), (2, "AT", 100.0, 120.0), (3, "DE", 0.0, 80.0), (4, "DE", 100.0, 40.0), (9, "FR", 1.0, 9.0)]
    d, h, p = [], [], []
    for i, c, bought, now in homes:
        for im in (1, 2):
            key = (3, i, c, im)
            known = not (i == 2 and im == 2)
            d.append((i, *key, 10.0 * i, 40.0 + i, 35.0, 3, "AT11" if c == "AT" else "DENW", 2.0, 2.0, 500.0, 7.0, 100.0, *[float(i)] * 7, None))
            h.append((i, *key, 10.0 * i, bought if known else None, now if known else None, 1985, 60.0, 5.0, 1.0, 20.0))
            p += [(10 * i + 1, i, *key, 1, 1, 2, 5, 1), (10 * i + 2, i, *key, 2, 2, 1, 1, 2)]
    spark_d = spark.createDataFrame(d, f"ID int, {KEYS}, hw0010 double, DHAGEH1B double, DHAGEH1 double, DHEDUH1 int, DHREGION string, DH0001 double, dh0006 double, DI2000 double, DNNLA double, DN3001 double, " + ", ".join(f"{n} double" for n in INCOMES))
    spark_h = spark.createDataFrame(h, f"id int, {KEYS}, HW0010 double, HB0800 double, hb0900 double, HB0700 int, HB0100 double, docogood double, DOFOODC double, HI0210 double")
    spark_p = spark.createDataFrame(p, f"ID int, HID int, {KEYS}, RA0100 int, RA0200 int, PA0100 int, PA0200 int, PE0100A int")
    return spark_p, spark_d, spark_h


def test_household_table(tables):
    got = {(r.ID, r.IM0100): r for r in analysis.household_table(*tables).collect()}
    assert len(got) == 8
    one = got[1, 1]
    assert (one.PERSON_ID, one.female, one.working, one.married, one.college, one.children) == (11, 1, 1, 1, 1, 0.0)
    assert (one.famstruct, one.agedum, one.region, one.age_group) == (5, 5, "Burgenland", "26-35")
    assert (one.income, one.income_psid, one.total_gross_income) == (3.0, 7.0, 7.0)
    assert (one.change_ratio, one.change_absolute, one.year_acquisition_category) == (2.5, 150.0, "1980-1989")
    assert (one.age_main_residence, one.significant_increase, one.total_c, one.htm_status) == (36, 1, 246.0, 0)
    assert got[3, 1].change_category == CHANGE_LEVELS[-1] and got[4, 2].change_category == CHANGE_LEVELS[0]
    assert got[2, 2].change_category is None and got[2, 2].significant_increase is None


def test_change_distribution(tables):
    out = analysis.change_distribution(analysis.household_table(*tables))
    got = {(r.SA0100, r.change_category): (r.weighted_count, r.proportion) for r in out.collect()}
    assert len(got) == 10
    assert got["AT", "Increase > 100%"] == (10.0, 0.5) and got["AT", "Increase 0-50%"] == (10.0, 0.5)
    assert got["DE", "Decrease > 50%"] == (40.0, pytest.approx(4 / 7))
    by_period = analysis.change_distribution(analysis.household_table(*tables), by_period=True)
    assert by_period.count() == 50
    known = by_period.where("proportion IS NOT NULL").collect()
    assert {r.year_acquisition_category for r in known} == {"1980-1989"}


def test_replicates_and_groups(tables, spark):
    weights = spark.createDataFrame(
        [(c, i, 3, 10.0 * i, 12.0 * i, None) for i, c in ((1, "AT"), (2, "AT"), (3, "DE"), (4, "DE"), (9, "FR"))],
        "sa0100 string, sa0010 int, survey int, wr0001 double, WR0002 double, Wr0003 double",
    )
    table = analysis.weight_table(weights)
    assert table.count() == 4 and table.where("WR0003 = 0").count() == 4
    households = analysis.household_table(*tables)
    df, design = analysis.with_replicates(households, table, ["SA0100", "SA0010", "SURVEY"], "WR0001", "WR0002")
    assert design.replicate_scale == 0.5
    out = survey.replicate_variance(df, {"change_category": CHANGE_LEVELS, "SA0100": ["AT", "DE"]}, design, ["SA0100"])
    top = {(r.SA0100, r.change_category): r for r in out.collect()}["AT", "Increase > 100%"]
    assert (top.total, top.var_total) == (10.0, pytest.approx(2.0))
    assert top.var_share == pytest.approx(0.0)
    groups = analysis.comparison_table(households).groupBy("group").count().collect()
    assert {tuple(r) for r in groups} == {("Austria >100%", 2), ("Austria 0-50%", 1), ("Germany >100%", 2)}


def test_joins_meet_filtered_tables(tables, spark):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plan = analysis.household_table(*tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert plan.count("Exchange hashpartitioning") == 3
    assert prep.has_column(analysis.household_table(*tables), "per_capita_consumption")
