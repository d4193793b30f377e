"""Column expressions against the missing-value and boundary rules."""

import math

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import expr as e
from hearthstat.plans import variables as v

INF = float("inf")


def values(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select("i", column.alias("out")).orderBy("i").select("out").collect()]


def test_ratio(spark):
    rows = [(1.0, 2.0), (3.0, 0.0), (-3.0, 0.0), (0.0, 0.0), (None, 2.0), (1.0, None), (None, 0.0)]
    got = values(spark, "a double, b double", rows, e.ratio("a", "b"))
    assert got == [0.5, INF, -INF, None, None, None, None]


def test_change_classes_are_right_closed(spark):
    pairs = [(0.0, 1.0), (0.5, 1.0), (0.5000001, 1.0), (1.0, 1.0), (1.5, 1.0), (2.0, 1.0), (2.0000001, 1.0),
             (5.0, 0.0), (0.0, 0.0), (-5.0, 0.0), (-1.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame([(i, b, a) for i, (a, b) in enumerate(pairs)], "i int, hb0800 double, hb0900 double")
    out = [r.change_category for r in v.with_changes(df).orderBy("i").collect()]
    d2, d1, i1, i2, i3 = v.CHANGE_LEVELS
    assert out == [d2, d2, d1, d1, i1, i2, i3, i3, None, None, None, None]
    # The cheap row filter keeps exactly the rows with a class.
    kept = {r.i for r in v.with_known_change(df).collect()}
    assert kept == {i for i, c in enumerate(out) if c is not None}


def test_cut_age_groups(spark):
    rows = [(x,) for x in (18, 25, 26, 35, 85, 86, 17, None)]
    got = values(spark, "a int", rows, e.cut("a", v.AGE_BREAKS, v.AGE_LEVELS))
    assert got == ["18-25", "18-25", "26-35", "26-35", "76-85", None, None, None]
    open_start = values(spark, "a int", [(18,), (19,)], e.cut("a", [18, 25], include_lowest=False))
    assert open_start == [None, 1]
    with pytest.raises(ValueError):
        e.cut("a", [1, 1, 2])
    with pytest.raises(ValueError):
        e.cut("a", [1, 2], ["one", "two"])


def test_closed_bands_have_gaps(spark):
    rows = [(x,) for x in (19.0, 20.0, 24.0, 24.5, 79.0, 80.0, None)]
    assert values(spark, "a double", rows, e.closed_bands("a", v.AGE_BANDS)) == [0, 1, 1, 0, 12, 0, 0]


def test_half_open_bands(spark):
    rows = [(x,) for x in (1979, 1980, 1989, 1990, 2009, 2010, None)]
    got = values(spark, "hb0700 int", rows, v.acquisition_period())
    assert got == ["Before 1980", "1980-1989", "1980-1989", "1990-1999", "2000-2009", "2010+", None]


def test_flags(spark):
    rows = [(1,), (2,), (None,)]
    assert values(spark, "a int", rows, e.flag(F.col("a") == 1)) == [1, 0, None]
    assert values(spark, "a int", rows, e.flag_or_zero(F.col("a") == 1)) == [1, 0, 0]
    assert values(spark, "a int", rows, e.is_in("a", [1, 5])) == [True, False, False]


def test_row_sum(spark):
    rows = [(None, None), (1.0, None), (1.0, 2.0)]
    assert values(spark, "a double, b double", rows, e.row_sum(["a", "b"])) == [0.0, 1.0, 3.0]


def test_log_plus_one(spark):
    got = values(spark, "a double", [(0.0,), (math.e - 1,), (-1.0,), (-2.0,), (None,)], e.log_plus_one("a"))
    assert got == [0.0, pytest.approx(1.0), -INF, None, None]


def test_levels_and_lookups(spark):
    rows = [("b",), ("a",), ("x",), (None,)]
    assert values(spark, "a string", rows, e.level_index("a", ["a", "b"])) == [2, 1, None, None]
    assert values(spark, "a string", rows, e.as_level("a", ["a", "b"])) == ["b", "a", None, None]
    assert values(spark, "a string", rows, e.lookup("a", {"a": "A"})) == [None, "A", None, None]
    assert values(spark, "a string", rows, e.recode("a", {"a": "A"})) == ["b", "A", "x", None]


def test_first_match(spark):
    rules = [("0-50%", "low"), ("50-100%", "mid"), (">100%", "high")]
    rows = [("Austria 0-50%",), ("Austria 50-100%",), ("Germany >100%",), ("none",), (None,)]
    assert values(spark, "a string", rows, e.first_match("a", rules)) == ["low", "mid", "high", None, None]


def test_interaction_and_formats(spark):
    assert values(spark, "a string, b string", [("x", "y"), ("x", None)], e.interaction("a", "b")) == ["x.y", None]
    assert values(spark, "a string", [("x",)], e.interaction("a")) == ["x"]
    assert values(spark, "a double", [(0.256,)], e.format_percent("a", 1)) == ["25.6%"]
    assert values(spark, "a double", [(1234567.0,)], e.format_comma("a")) == ["1,234,567"]
    assert values(spark, "a double", [(25000.0,)], e.format_thousands("a")) == ["25K"]


def test_family_structure(spark):
    rows, expected = [], []
    for married in (0, 1):
        for kids in (-1.0, 0.0, 1.0, None):
            for age in (55, 56, None):
                rows.append((3 if married else 1, kids, 0.0, age))
                if kids is None or kids < 0:
                    code = None
                elif married:
                    code = 4 if kids > 0 else 5
                elif kids > 0:
                    code = 1
                else:
                    code = None if age is None else (2 if age <= 55 else 3)
                expected.append(code)
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "i int, pa0100 int, dh0001 double, dh0006 double, age int"
    )
    got = v.with_family(df).orderBy("i").collect()
    assert [r.famstruct for r in got] == expected
    assert {r.family for r in got if r.famstruct == 4} == {"Married with kids"}
