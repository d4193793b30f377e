import pytest
from pyspark.sql import functions as F

from hearthstat.operators import prep
from hearthstat.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "Id int, wr0001 int, WR0002 int, wr0003 int")
    up = prep.upper_names(df)
    assert up.columns == ["ID", "WR0001", "WR0002", "WR0003"]
    assert prep.columns_between(up, "WR0001", "WR0002") == ["WR0001", "WR0002"]
    with pytest.raises(ValueError):
        prep.columns_between(up, "WR0002", "WR0001")
    assert prep.rename(up, {"ID": "id", "GONE": "x"}).columns[0] == "id"
    assert prep.has_column(up, "ID") and not prep.has_column(up, "HID")


def test_fill_missing(spark):
    df = spark.createDataFrame([(None, None, "a")], "a double, b double, c string")
    assert rows(prep.fill_missing(df)) == [(0.0, 0.0, "a")]
    assert rows(prep.fill_missing(df, cols=["a"])) == [(0.0, None, "a")]


def test_stack_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "A int, B string")
    b = spark.createDataFrame([("y", 2)], "B string, A int")
    assert rows(prep.stack([a, b])) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        prep.stack([a, b.withColumnRenamed("A", "C")])


def test_left_join_missing_keys_match(spark):
    a = spark.createDataFrame([(1, None, 10), (2, 5, 20), (3, 5, 30)], "k int, j int, v int")
    b = spark.createDataFrame([(1, None, 11), (2, 5, 21), (2, 5, 22)], "k int, j int, v int")
    joined = prep.left_join(a, b, ["k", "j"])
    assert joined.columns == ["k", "j", "v_x", "v_y"]
    assert rows(joined) == [(1, None, 10, 11), (2, 5, 20, 21), (2, 5, 20, 22), (3, 5, 30, None)]
    strict = prep.left_join(a, b, ["k", "j"], missing_matches=False)
    assert (1, None, 10, None) in rows(strict)


def test_household_joins_share_their_shuffle(spark):
    keys = "ID int, SURVEY int, SA0010 int, SA0100 string, IM0100 int, HW0010 double"
    d = spark.createDataFrame([(1, 3, 1, "AT", 1, 2.0), (2, 3, 2, "AT", 1, None), (3, 3, 3, "AT", 1, 4.0)], keys)
    h = spark.createDataFrame(
        [(1, 3, 1, "AT", 1, 2.0, 10), (2, 3, 2, "AT", 1, None, 20), (3, 3, 3, "AT", 1, 5.0, 30)], keys + ", HB0700 int"
    )
    p = spark.createDataFrame([(11, 1, 3, 1, "AT", 1, 1)], "ID int, HID int, SURVEY int, SA0010 int, SA0100 string, IM0100 int, RA0100 int")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        out = prep.attach_reference(prep.merge_households(d, h), p)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
        assert rows(out.select("ID", "HB0700", "PERSON_ID")) == [(1, 10, 11), (2, 20, None), (3, None, None)]
    finally:
        spark.conf.set(limit, before)


def test_attach_reference(spark):
    keys = "SURVEY int, SA0010 int, SA0100 string, IM0100 int"
    d = spark.createDataFrame([(i, 3, None if i == 1 else i, "AT", 1) for i in (1, 2, 3)], f"ID int, {keys}")
    p = spark.createDataFrame(
        [
            (101, 1, 3, None, "AT", 1, 1), (102, 1, 3, None, "AT", 1, 2),
            (201, 2, 3, 2, "AT", 1, 1), (202, 2, 3, 2, "AT", 1, 1),
            (301, 3, 3, 3, "AT", 2, 1),
        ],
        f"ID int, HID int, {keys}, RA0100 int",
    )
    out = prep.attach_reference(d, p).select("ID", "PERSON_ID")
    assert rows(out) == [(1, 101), (2, 201), (2, 202), (3, None)]


def test_trim_uses_untrimmed_thresholds(spark):
    df = spark.createDataFrame([(float(i), float(101 - i)) for i in range(1, 101)] + [(None, 1.0)], "a double, b double")
    out = prep.trim_quantiles(df, upper={"a": 0.9, "b": 0.9})
    kept = [r.a for r in out.collect()]
    assert min(kept) == 11.0 and max(kept) == 90.0 and len(kept) == 80
    both = prep.trim_quantiles(df, upper={"a": 0.95}, lower={"a": 0.05})
    assert both.agg(F.min("a"), F.max("a")).first()[:] == (6.0, 95.0)


def test_trim_limits_reach_the_scan(spark):
    from hearthstat.sources.stored import store

    df = store(spark.range(100).selectExpr("double(id) AS a"))
    plan = prep.trim_quantiles(df, upper={"a": 0.9}, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(a,89" in plan and "Join" not in plan


def test_quantile_class_keeps_ties(spark):
    xs = [1.0] * 3 + [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = prep.quantile_class(df, "x", ["lo", "hi"], "c")
    assert {(r.x, r.c) for r in out.collect()} == {(x, "lo" if x <= 3.5 else "hi") for x in xs}
    with pytest.raises(ValueError):
        prep.quantile_class(df, "x", list("abcde"), "c")
    with pytest.raises(ValueError):
        prep.quantile_class(spark.createDataFrame([(1.0,)] * 4, "x double"), "x", ["a", "b"], "c")


def test_subsets_and_long_form(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0), (2, 1.0, 2.0), (3, None, 5.0)], "k int, a double, b double")
    tagged = prep.tag_subsets(df, [(F.col("k") == 1, "one"), (F.col("a").isNull(), "none")])
    assert rows(tagged.select("k", "group")) == [(1, "one"), (3, "none")]
    long = prep.to_long(df, ["a", "b"], "name", "value")
    assert long.count() == 6 and long.columns == ["k", "name", "value"]


def test_sources(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    tables.write_table(spark.createDataFrame([(1, "AT")], "id int, Country string"), a)
    tables.write_table(spark.createDataFrame([(2, "DE")], "id int, Country string"), b)
    both = tables.read_table(spark, [a, b])
    assert both.columns == ["ID", "COUNTRY"] and rows(both) == [(1, "AT"), (2, "DE")]
    c = str(tmp_path / "c")
    tables.write_csv(spark.createDataFrame([(1, None), (2, "x")], "id int, t string").coalesce(1), c)
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert text.splitlines() == ["id,t", "1,NA", "2,x"]
    with pytest.raises(ValueError):
        tables.read_table(spark, c, fmt="csv")
    back = tables.read_table(spark, c, "id int, t string", "csv", header=True, nullValue="NA")
    assert rows(back) == [(1, None), (2, "x")]
    tables.write_table(both, a + "p", partition_by=["COUNTRY"])
    assert (tmp_path / "ap" / "COUNTRY=AT").is_dir()
