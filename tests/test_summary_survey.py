import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hearthstat.operators import summary, survey

# Published survey result: weighted counts per country and class, and their shares within the country.
SHARES = {
    "AT": ([60929, 164731, 1462735, 761410, 1871870], [0.0141, 0.0381, 0.338, 0.176, 0.433]),
    "DE": ([411085, 3122481, 13039347, 8943538, 15092500], [0.0101, 0.0769, 0.321, 0.220, 0.372]),
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_share_reproduces_published_result(spark):
    data = [(c, i, float(w)) for c, (ws, _) in SHARES.items() for i, w in enumerate(ws)]
    out = survey.share(spark.createDataFrame(data, "c string, i int, w double"), "w", ["c"])
    for r in out.collect():
        assert r.proportion == pytest.approx(SHARES[r.c][1][r.i], rel=4e-3)


def test_share_of_nothing_is_missing(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0)], "g string, w double")
    assert rows(survey.share(df, "w", ["g"])) == [("a", 0.0, None), ("a", 0.0, None), ("b", 1.0, 1.0)]


LEVELS = {"cat": ["lo", "hi"], "c": ["AT", "DE"]}
DESIGN = survey.Design(weight="w", implicate="im")
RECORDS = [
    (1, "lo", "AT", 10.0), (1, "hi", "AT", 30.0), (2, "lo", "AT", 20.0),  # no "hi" in implicate 2
    (3, None, "AT", 7.0), (3, "lo", "FR", 9.0),  # implicate 3 has no cell at all
]


def test_implicate_mean_counts_absent_cells_as_zero(spark):
    df = spark.createDataFrame(RECORDS, "im int, cat string, c string, w double")
    out = survey.implicate_mean(df, LEVELS, DESIGN)
    assert rows(out) == [("hi", "AT", 10.0), ("hi", "DE", 0.0), ("lo", "AT", 10.0), ("lo", "DE", 0.0)]
    shares = survey.share(out, "weighted_count", ["c"])
    assert {(r.cat, r.c): r.proportion for r in shares.collect()}["lo", "DE"] is None
    ordered = survey.in_level_order(out, {"c": LEVELS["c"], "cat": LEVELS["cat"]}).collect()
    assert [(r.c, r.cat) for r in ordered] == [("AT", "lo"), ("AT", "hi"), ("DE", "lo"), ("DE", "hi")]


def test_weighted_table_is_dense(spark):
    df = spark.createDataFrame(RECORDS, "im int, cat string, c string, w double")
    got = {(r.im, r.cat, r.c): r.weighted_count for r in survey.weighted_table(df, LEVELS, DESIGN).collect()}
    assert len(got) == 12
    assert got[1, "hi", "AT"] == 30.0 and got[2, "hi", "AT"] == 0.0 and got[3, "lo", "AT"] == 0.0


def test_weights_join_by_key(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (None, 7.0)], "id int, w double")
    good = spark.createDataFrame([(2, 1.0, None), (1, 2.0, 4.0), (None, 9.0, 9.0), (8, 0.0, 0.0)], "id int, r1 double, r2 double")
    assert rows(survey.attach_weights(df, good, ["id"], ["r1", "r2"])) == [
        (1, 5.0, 2.0, 4.0), (2, 6.0, 1.0, 0.0), (None, 7.0, 9.0, 9.0),
    ]
    with pytest.raises(ValueError, match="several"):
        survey.attach_weights(df, good.union(good), ["id"], ["r1"])
    with pytest.raises(PySparkException, match="without replicate weights"):
        survey.attach_weights(df, good.where("id = 1"), ["id"], ["r1"]).agg(F.sum("r1")).collect()
    with pytest.raises(PySparkException, match="without replicate weights"):
        survey.attach_weights(df, good.where("id = 1"), ["id"], ["r1"]).select("id").collect()


def test_replicate_variance_against_brute_force(spark):
    rng = random.Random(5)
    names = [f"r{i}" for i in range(6)]
    data = [
        (rng.choice([1, 2]), rng.choice(["lo", "hi", None]), rng.choice(["AT", "DE"]), rng.random(), *[rng.random() for _ in names])
        for _ in range(60)
    ]
    df = spark.createDataFrame(data, "im int, cat string, c string, w double, " + ", ".join(f"{n} double" for n in names))
    design = survey.Design(weight="w", implicate="im", replicates=tuple(names), scale=1.0, rscale=1 / 6)
    for r in survey.replicate_variance(df, LEVELS, design, ["c"]).collect():
        total = [sum(q[3 + k] for q in data if q[1] == r.cat and q[2] == r.c) / 2 for k in range(7)]
        country = [sum(q[3 + k] for q in data if q[1] and q[2] == r.c) / 2 for k in range(7)]
        share = [t / c for t, c in zip(total, country)]
        assert r.total == pytest.approx(total[0]) and r.share == pytest.approx(share[0])
        assert r.var_total == pytest.approx(sum((t - total[0]) ** 2 for t in total[1:]) / 6)
        assert r.var_share == pytest.approx(sum((s - share[0]) ** 2 for s in share[1:]) / 6)


@pytest.mark.parametrize("combined", [True, False])
@pytest.mark.parametrize("replicates", [6, 1000])
def test_household_replicates_against_brute_force(spark, combined, replicates):
    rng = random.Random(6)
    vectors = {h: [rng.choice([0.0, 0.5, 1.5, None]) for _ in range(replicates)] for h in [*range(12), None]}
    data = [
        (h, rng.choice([1, 2]), rng.choice(["lo", "hi", None, "other"]), rng.choice(["AT", "DE"]), rng.choice([0.0, rng.random()]))
        for h in vectors for _ in range(6)
    ]
    data.append((3, None, "lo", "AT", 99.0))  # in no implicate
    df = spark.createDataFrame(data, "id int, im int, cat string, c string, w double")
    weights = spark.createDataFrame(list(vectors.items()), "id int, replicates array<double>").repartition(3)
    design = survey.Design(weight="w", implicate="im", combined=combined)
    out = survey.household_replicate_variance(df, weights, ["id"], LEVELS, design, ["c"]).collect()
    data.pop()
    assert {(r.cat, r.c) for r in out} == {(q[2], q[3]) for q in data if q[2] in ("lo", "hi")}

    def total(r, keep):
        return sum((q[4] if r == 0 else (vectors[q[0]][r - 1] or 0.0) * (1 if combined else q[4])) for q in data if keep(q)) / 2

    for row in out:
        totals = [total(k, lambda q: (q[2], q[3]) == (row.cat, row.c)) for k in range(replicates + 1)]
        country = [total(k, lambda q: q[2] in ("lo", "hi") and q[3] == row.c) for k in range(replicates + 1)]
        share = [t / c if c else None for t, c in zip(totals, country)]
        assert row.total == pytest.approx(totals[0]) and row.share == pytest.approx(share[0])
        assert row.var_total == pytest.approx(sum((t - totals[0]) ** 2 for t in totals[1:]) / replicates)
        if None not in share:
            assert row.var_share == pytest.approx(sum((s - share[0]) ** 2 for s in share[1:]) / replicates)


def test_households_need_one_row_of_replicates(spark):
    df = spark.createDataFrame([(1, 1, "lo", "AT", 1.0), (2, 1, "hi", "AT", 1.0)], "id int, im int, cat string, c string, w double")
    one, two = ([(h, [1.0])] for h in (1, 2))
    for weights, said in ((one, "without replicate weights"), (one + two + two, "several rows")):
        table = spark.createDataFrame(weights, "id int, replicates array<double>")
        with pytest.raises(PySparkException, match=said):
            survey.household_replicate_variance(df, table, ["id"], LEVELS, DESIGN, ["c"]).collect()


def test_a_household_is_joined_once(spark):
    """Neither the replicates nor a household's implicates show in the plan: one exchange carries the arrays."""
    df = spark.range(100).selectExpr("id % 20 AS id", "int(id % 5) AS im", "'lo' AS cat", "'AT' AS c", "1D AS w")
    weights = spark.range(20).selectExpr("id", "transform(sequence(1, 500), x -> double(x)) AS replicates")
    out = survey.household_replicate_variance(df, weights, ["id"], LEVELS, DESIGN, ["c"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 100_000 and plan.count("summary") <= 8


def test_crosstab_shows_zero_and_missing_cells(spark):
    df = spark.createDataFrame([("AT", "lo"), ("AT", None), ("AT", None), ("DE", "odd")], "c string, cat string")
    out = summary.crosstab(df, {"c": ["AT", "DE"], "cat": ["lo", "hi"]})
    got = {(r.c, r.cat): r.n for r in out.collect()}
    # A value outside the levels is missing; no row misses the country, so that level is not shown.
    assert got == {("AT", "lo"): 1, ("AT", "hi"): 0, ("AT", None): 2, ("DE", "lo"): 0, ("DE", "hi"): 0, ("DE", None): 1}
    freq = summary.frequency(df.where("cat = 'lo'"), "cat", ["lo", "hi"])
    assert rows(freq) == [("hi", 0, 2), ("lo", 1, 1)]


def test_null_profile_and_six_numbers(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 4.0), (9.0, None)], "a double, b double")
    assert rows(summary.null_profile(df, ["a", "b"])) == [("a", 4, 1, 0.25), ("b", 4, 3, 0.75)]
    got = {r.variable: tuple(r)[1:] for r in summary.six_numbers(df, ["a", "b"]).collect()}
    assert got["a"] == (1.0, 1.5, 2.0, 4.0, 5.5, 9.0, 1)
    assert got["b"] == (4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 3)


def test_extreme_profile_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 5.0), ("d", None)], "region string, m double")
    got = rows(summary.extreme_profile(df, ["m"]).select("region", "extreme"))
    assert got == [("a", "min"), ("b", "max"), ("c", "max")]
    assert rows(summary.value_range(df, "m")) == [(1.0, 5.0)]


def test_rows_without_implicate_belong_to_none(spark):
    rows = [("a", 1, 10.0), ("a", 2, 20.0), ("a", None, 10.0)]
    df = spark.createDataFrame(rows, "c string, im int, w double")
    design = survey.Design("w", "im")
    assert [r.weighted_count for r in survey.implicate_mean(df, {"c": ["a"]}, design).collect()] == [15.0]
    table = {r.im: r.weighted_count for r in survey.weighted_table(df, {"c": ["a"]}, design).collect()}
    assert table == {1: 10.0, 2: 20.0}


def test_design_without_implicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("x", 9.0)], "c string, w double")
    levels = {"c": ["a", "b"]}
    for table in (survey.weighted_table(df, levels, survey.Design("w")), survey.implicate_mean(df, levels, survey.Design("w"))):
        assert {r.c: r.weighted_count for r in table.collect()} == {"a": 3.5, "b": 0.0}
