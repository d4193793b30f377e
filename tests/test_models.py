import math
import random

import numpy as np
import pytest

from hearthstat.functions import tails
from hearthstat.operators import models
from hearthstat.operators.moments import pair_moments, with_pooled

# Published test results: r, df, t, p (None where only a bound is printed), 95 % interval.
CORRELATION_TESTS = [
    (0.1451296, 17073, 19.166, None, 0.1304141, 0.1597812),
    (-0.01532924, 17073, -2.0032, 0.04517, -0.0303216497, -0.0003299367),
    (0.105256, 4913, 7.4189, 1.384e-13, 0.07752621, 0.13282315),
    (0.02070045, 17073, 2.7054, 0.006829, 0.005702844, 0.035688752),
    (0.06753819, 4913, 4.7448, 2.147e-06, 0.0396551, 0.09531619),
    (0.01818098, 12158, 2.005, 0.04498, 0.0004069515, 0.0359435294),
    (0.02650862, 4913, 1.8587, 0.06313, -0.001450426, 0.054426262),
    (0.04997861, 17073, 6.5386, 6.387e-11, 0.03500547, 0.06492932),
    (0.04579508, 12158, 5.0548, 4.371e-07, 0.02804375, 0.06351754),
    (0.03970674, 4913, 2.7854, 0.005367, 0.01176182, 0.06758968),
    (0.09331465, 4913, 6.5693, 5.577e-11, 0.06552763, 0.12095706),
    (0.0220021, 4913, 1.5426, 0.123, -0.005959537, 0.049929367),
    (-0.03526242, 12158, -3.8906, 0.0001005, -0.05300336, -0.01749922),
    (0.607397, 12158, 84.307, None, 0.5960579, 0.6184939),
    (0.6448041, 4913, 59.13, None, 0.6281704, 0.6608487),
]


def test_published_correlation_tests(spark):
    df = spark.createDataFrame([(str(i), r[0], r[1] + 2) for i, r in enumerate(CORRELATION_TESTS)], "pair string, r double, n long")
    for got in models.corr_inference(df).collect():
        r, dof, t, p, low, high = CORRELATION_TESTS[int(got.pair)]
        assert got.df == dof
        assert got.t == pytest.approx(t, rel=6e-4)
        assert (got.ci_low, got.ci_high) == (pytest.approx(low, abs=2e-6), pytest.approx(high, abs=2e-6))
        if p is None:
            assert got.p < 2.2e-16
        else:
            assert got.p == pytest.approx(p, rel=6e-4)


def test_tail_areas():
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert tails.t_two_sided(math.sqrt(2), 2) == pytest.approx(1 - math.sqrt(0.5))
    assert tails.t_two_sided(0.0, 7) == 1.0
    assert tails.f_upper(4.0, 1, 9) == pytest.approx(tails.t_two_sided(2.0, 9))
    assert tails.t_quantile(0.95, 1) == pytest.approx(math.tan(math.pi * 0.475))
    assert tails.t_quantile(0.95, 1e7) == pytest.approx(tails.NORMAL_975, abs=1e-6)
    assert tails.t_two_sided(tails.t_quantile(0.95, 12), 12) == pytest.approx(0.05)
    assert math.isnan(tails.t_two_sided(1.0, 0))
    # Many degrees of freedom: the normal tail, and no loss of digits between close cases.
    assert tails.t_two_sided(1.5, 1e9) == pytest.approx(math.erfc(1.5 / math.sqrt(2)), rel=1e-8)
    assert tails.t_two_sided(3.0, 99.999) == pytest.approx(tails.t_two_sided(3.0, 100.001), rel=1e-5)


def sample(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(["AT", "DE", "DE"])
        z = rng.gauss(1e6, 2e5)
        x = z * 0.5 + rng.gauss(0, 1e5)
        w = rng.gauss(3, 1) + (x - 5e5) / 1e5
        y = 3.0 + 0.2 * x - 40 * w + rng.gauss(0, 1e4)
        out.append((g, y, x, w, z))
    out += [("AT", None, 1.0, 1.0, 1.0), ("DE", 1.0, None, 1.0, 1.0), ("DE", float("inf"), 1.0, 1.0, 1.0), (None, 2.0, 3.0, 4.0, 5.0)]
    return out


SCHEMA = "g string, y double, x double, w double, z double"


def clean(rows, scope, cols):
    keep = [r for r in rows if scope == "ALL" or r[0] == scope]
    keep = [[r[c] for c in cols] for r in keep]
    return np.array([r for r in keep if all(v is not None and math.isfinite(v) for v in r)])


@pytest.fixture(scope="module")
def data(spark):
    rows = sample()
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def test_pooled_moments_equal_direct_ones(data):
    rows, df = data
    for r in with_pooled(pair_moments(df, "g", {"p": ("x", "y")}), "g").collect():
        m = clean(rows, r.scope, [2, 1])
        assert r.n == len(m) and r.mean_x == pytest.approx(m[:, 0].mean())
        c = np.cov(m.T, bias=True) * len(m)
        assert (r.sxx, r.syy, r.sxy) == (pytest.approx(c[0, 0]), pytest.approx(c[1, 1]), pytest.approx(c[0, 1]))


def test_pooled_moments_of_very_many_groups(spark):
    """No window over the pooled rows, and no loss from large means."""
    df = spark.range(300_000).selectExpr("id % 100000 AS g", "1e9 + pmod(id * 7919, 1000) AS x", "double(id % 13) AS y")
    m = with_pooled(pair_moments(df, "g", {"p": ("x", "y")}), "g")
    assert "Window" not in m._jdf.queryExecution().executedPlan().toString()
    row = m.where("scope = 'ALL'").first()
    ids = np.arange(300_000)
    x, y = 1e9 + ids * 7919 % 1000, ids % 13
    assert row.n == 300_000 and row.mean_x == pytest.approx(x.mean(), rel=1e-15)
    assert row.sxx == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-9)
    assert row.sxy == pytest.approx(((x - x.mean()) * (y - y.mean())).sum(), rel=1e-6, abs=1e-2)
    assert m.where("scope <> 'ALL'").count() == 100_000


def test_correlation_policies(spark):
    rows = [("AT", 1.0, 2.0, 5.0), ("AT", 2.0, 1.0, 5.0), ("AT", 3.0, 7.0, 5.0), ("AT", None, 4.0, 5.0), ("DE", 1.0, 1.0, 5.0), ("DE", 2.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, k double")
    pairs = {"ab": ("a", "b"), "ak": ("a", "k"), "kb": ("k", "b")}
    got = {(r.scope, r.pair): r for r in models.corr_panel(df, "g", pairs, strict=["ab"]).collect()}
    assert got["ALL", "ab"].r is None and got["ALL", "ab"].n_dropped == 1
    assert got["AT", "ab"].r == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 7])[0, 1])
    assert got["AT", "ak"].r is None and got["ALL", "kb"].r is None
    test = {(r.scope, r.pair): r for r in models.corr_test(df, "g", pairs).collect()}
    assert test["ALL", "ab"].r is not None  # the test leaves incomplete rows out
    two, three = test["DE", "ab"], test["AT", "ab"]
    assert (two.df, two.t, two.p, two.ci_low) == (None, None, None, None)
    assert three.df == 1 and three.p is not None and three.ci_low is None
    assert test["AT", "ak"].t is None and test["AT", "ak"].p is None


def numpy_ols(y, X):
    X = np.column_stack([np.ones(len(y)), X])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    s2 = e @ e / (len(y) - X.shape[1])
    return beta, np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2), e, s2


def test_simple_fit(data):
    rows, df = data
    for r in models.ols_simple(df, "g", {"m": ("x", "y")}).collect():
        m = clean(rows, r.scope, [1, 2])
        beta, se, e, s2 = numpy_ols(m[:, 0], m[:, 1:])
        assert (r.intercept, r.slope) == (pytest.approx(beta[0], rel=1e-6), pytest.approx(beta[1]))
        assert (r.se_intercept, r.se_slope) == (pytest.approx(se[0]), pytest.approx(se[1]))
        assert r.r2 == pytest.approx(1 - e @ e / ((m[:, 0] - m[:, 0].mean()) ** 2).sum())
        assert r.p_slope == pytest.approx(tails.t_two_sided(beta[1] / se[1], len(m) - 2), abs=1e-12)


def test_multiple_fit_and_residuals(data):
    rows, df = data
    table = models.ols(df, "g", "y", ["x", "w"]).collect()
    for scope in ("ALL", "AT", "DE"):
        m = clean(rows, scope, [1, 2, 3])
        beta, se, e, s2 = numpy_ols(m[:, 0], m[:, 1:])
        mine = {r.term: r for r in table if r.scope == scope}
        got = [mine[t] for t in ("(Intercept)", "x", "w")]
        assert [r.estimate for r in got] == pytest.approx(list(beta), rel=1e-6)
        assert [r.std_error for r in got] == pytest.approx(list(se), rel=1e-8)
        assert got[0].n == len(m) and got[0].df == len(m) - 3 and got[0].sigma == pytest.approx(math.sqrt(s2))
        tss = ((m[:, 0] - m[:, 0].mean()) ** 2).sum()
        assert got[0].f == pytest.approx((tss - e @ e) / 2 / s2)
        assert got[0].adj_r2 == pytest.approx(1 - s2 / (tss / (len(m) - 1)))
        # Residuals are orthogonal to the regressors.
        X = np.column_stack([np.ones(len(m)), m[:, 1:]])
        own = m[:, 0] - X @ np.array([r.estimate for r in got])
        assert np.abs(X.T @ own / np.abs(X.T) .sum(axis=1)).max() < 1e-6
    res = {r.scope: r for r in models.residual_summary(df, "g", "y", ["x", "w"]).collect()}
    m = clean(rows, "DE", [1, 2, 3])
    e = numpy_ols(m[:, 0], m[:, 1:])[2]
    want = np.quantile(e, [0, 0.25, 0.5, 0.75, 1])
    de = res["DE"]
    got = [de.min_residual, de.p25_residual, de.median_residual, de.p75_residual, de.max_residual]
    assert got == pytest.approx(list(want), rel=1e-6)
    assert "ALL" in res


def test_multiple_fit_agrees_with_ml(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    _, df = data
    rows = df.where("g = 'DE' AND y < double('infinity') AND x IS NOT NULL")
    ready = VectorAssembler(inputCols=["x", "w"], outputCol="features").transform(rows)
    fit = LinearRegression(labelCol="y", solver="normal").fit(ready)
    mine = {r.term: r for r in models.ols(df, "g", "y", ["x", "w"]).where("scope = 'DE'").collect()}
    assert [mine["x"].estimate, mine["w"].estimate] == pytest.approx(list(fit.coefficients), rel=1e-6)
    assert [mine["x"].p, mine["w"].p] == pytest.approx(fit.summary.pValues[:2], abs=1e-9)


def test_singular_and_small_fits_are_missing(spark):
    df = spark.createDataFrame([("AT", float(i), float(i % 3), 2.0 * (i % 3), 1.0) for i in range(9)] + [("DE", 1.0, 2.0, 5.0, 1.0)], SCHEMA)
    alone = {(r.scope, r.term): r for r in models.ols(df, "g", "y", ["x"]).collect()}
    for xs in (["x", "w"], ["x", "z"]):
        table = {(r.scope, r.term): r for r in models.ols(df, "g", "y", xs).collect()}
        # A regressor that those before it give has no estimate; the others are those of the fit without it.
        for term in ("(Intercept)", "x"):
            for name in ("estimate", "std_error", "p", "df", "sigma", "r2", "adj_r2", "f_p"):
                assert getattr(table["AT", term], name) == pytest.approx(getattr(alone["AT", term], name)), (xs, term, name)
        assert table["AT", xs[1]].estimate is None and table["AT", xs[1]].df == 7
        assert all(table["DE", term].estimate is None for term in ("(Intercept)", *xs))
    simple = {r.scope: r for r in models.ols_simple(df, "g", {"m": ("z", "y")}).collect()}
    flat = simple["AT"]
    assert flat.slope is None and (flat.intercept, flat.df, flat.r2) == pytest.approx((4.0, 8.0, 0.0))
    assert flat.se_intercept == pytest.approx(np.std(np.arange(9), ddof=1) / 3)
    fit = models.iv(df, "g", "y", ["x", "w"], ["x", "w"]).where("scope = 'AT'").collect()
    assert {r.term: r.estimate is None for r in fit} == {"(Intercept)": False, "x": False, "w": True}


def near_collinear(noise, n=4000):
    rng = np.random.default_rng(4)
    x = rng.normal(50, 10, n)
    z = x + noise * rng.normal(0, 1, n)
    y = 3 + 2 * x - 5 * (z - x) / max(noise, 1e-300) + rng.normal(0, 1, n)
    return x, z, y


@pytest.mark.parametrize("noise, estimated", [(1e-2, True), (1e-4, True), (1e-6 * 50, True), (1e-10, False), (0.0, False)])
def test_near_collinear_regressors_as_by_householder(spark, noise, estimated):
    """A regressor counts if a ten-millionth of its length is its own; squared lengths would lose it much earlier."""
    x, z, y = near_collinear(noise)
    data = list(zip(["a"] * len(x), y.tolist(), x.tolist(), z.tolist()))
    df = spark.createDataFrame(data, "g string, y double, x double, z double").repartition(7)
    got = {r.term: r for r in models.ols(df, "g", "y", ["x", "z"]).where("scope = 'ALL'").collect()}
    assert (got["z"].estimate is not None) == estimated
    assert got["x"].df == len(x) - 2 - estimated
    # The same fit on the difference of both, which is not collinear.
    if estimated:
        beta, se, e, s2 = numpy_ols(y, np.column_stack([x, (z - x) / noise]))
        assert got["z"].estimate == pytest.approx(beta[2] / noise, rel=1e-3)
        assert got["z"].std_error == pytest.approx(se[2] / noise, rel=1e-3)
        assert got["x"].sigma == pytest.approx(math.sqrt(s2), rel=1e-6)


def test_noise_of_a_millionth(spark):
    """x and z = x + 1e-6 noise, of lengths around 1: two estimates."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 3000)
    z = x + 1e-6 * rng.normal(0, 1, 3000)
    y = x + rng.normal(0, 1, 3000)
    df = spark.createDataFrame(list(zip(["a"] * 3000, y.tolist(), x.tolist(), z.tolist())), "g string, y double, x double, z double")
    assert all(r.estimate is not None for r in models.ols(df, "g", "y", ["x", "z"]).collect())


def test_many_groups_and_tasks(spark, monkeypatch):
    """Factors leave a task before they are many, and the merge gives the same fits."""
    monkeypatch.setattr(models, "OPEN_GROUPS", 5)
    monkeypatch.setattr(models, "CHUNK", 3)
    rng = random.Random(8)
    rows = [(f"g{i % 40}" if i % 40 else None, rng.gauss(0, 1), rng.gauss(1e4, 1), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, y double, x double, w double").repartition(9)
    got = {(r.scope, r.term): r for r in models.ols(df, "g", "y", ["x", "w"]).collect()}
    assert {s for s, _ in got} == {"ALL", *[f"g{i}" for i in range(1, 40)]}
    for scope in ("ALL", "g7"):
        m = np.array([r[1:] for r in rows if scope == "ALL" or r[0] == scope])
        beta, se, _, _ = numpy_ols(m[:, 0], m[:, 1:])
        assert [got[scope, t].estimate for t in ("(Intercept)", "x", "w")] == pytest.approx(list(beta), rel=1e-6)
        assert [got[scope, t].std_error for t in ("(Intercept)", "x", "w")] == pytest.approx(list(se), rel=1e-6)
        assert got[scope, "x"].n == len(m)


def test_fits_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, y double, x double, w double")
    assert all(r.estimate is None and r.n == 0 for r in models.ols(df, "g", "y", ["x", "w"]).collect())


def test_a_group_named_like_the_pooled_result(spark):
    rows = [("ALL", 1.0, 1.0), ("ALL", 2.0, 3.0), ("B", 4.0, 2.0), ("B", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, y double, x double")
    got = {r.scope: r.n for r in models.corr_panel(df, "g", {"p": ("x", "y")}).collect()}
    assert got == {"ALL": 4, '"ALL"': 2, "B": 2}
    res = {r.scope for r in models.residual_summary(df, "g", "y", ["x"]).collect()}
    assert res == {"ALL", '"ALL"', "B"}


@pytest.mark.parametrize("df", [1e8, 1e10, 1e11, 1e12, 1e14])
def test_tails_with_many_degrees_of_freedom(df):
    normal = math.erfc(2 / math.sqrt(2))
    density = math.exp(-2) / math.sqrt(2 * math.pi)
    assert tails.t_two_sided(2.0, df) == pytest.approx(normal + 2 * density * 10 / (4 * df), rel=1e-9)
    assert tails.t_quantile(0.95, df) == pytest.approx(tails.NORMAL_975, rel=max(1e-9, 2 / df))


def test_tails_meet_where_the_method_changes():
    for t in (0.1, 1.0, 2.0, 5.0, 10.0):
        x = tails.NEAR_NORMAL
        exact = tails.beta_area(x / 2, 0.5, x / (x + t * t), t * t / (x + t * t))
        assert tails.t_two_sided(t, x) == pytest.approx(exact, rel=1e-9)


def test_a_fraction_that_does_not_converge_is_an_error(monkeypatch):
    monkeypatch.setattr(tails.math, "isqrt", lambda n: -499)
    with pytest.raises(ArithmeticError):
        tails.f_upper(1.0, 5e7, 5e9)


def test_instrument_cases(data, spark):
    rows, df = data
    table = models.iv(df, "g", "y", ["x"], ["z"]).collect()
    for scope in ("ALL", "AT", "DE"):
        m = clean(rows, scope, [1, 2, 4])
        y, x, z = m.T
        b = np.cov(z, y)[0, 1] / np.cov(z, x)[0, 1]
        a = y.mean() - b * x.mean()
        e = y - a - b * x
        n = len(m)
        fitted = np.cov(z, x, bias=True)[0, 1] ** 2 * n / np.var(z)
        s2 = e @ e / (n - 2)
        mine = {r.term: r for r in table if r.scope == scope}
        assert mine["x"].estimate == pytest.approx(b, rel=1e-9)
        assert mine["x"].std_error == pytest.approx(math.sqrt(s2 / fitted), rel=1e-9)
        assert mine["(Intercept)"].std_error == pytest.approx(math.sqrt(s2 * (1 / n + x.mean() ** 2 / fitted)), rel=1e-9)
        assert mine["x"].r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    own = {(r.scope, r.term): r for r in models.iv(df, "g", "y", ["x"], ["x"]).collect()}
    for r in models.ols(df, "g", "y", ["x"]).collect():
        assert own[r.scope, r.term].estimate == pytest.approx(r.estimate)
        assert own[r.scope, r.term].std_error == pytest.approx(r.std_error)
    flat = spark.createDataFrame([("AT", y, x, 0.0, z) for y, x, z in [(1.0, 1.0, 1.0), (2.0, -1.0, 1.0), (3.0, 1.0, -1.0), (5.0, -1.0, -1.0)]], SCHEMA)
    assert all(r.estimate is None for r in models.iv(flat, "g", "y", ["x"], ["z"]).collect())
    with pytest.raises(ValueError):
        models.iv(df, "g", "y", ["x", "w"], ["z"])


def test_overidentified_model(data):
    rows, df = data
    got = {r.term: r.estimate for r in models.iv(df, "g", "y", ["x"], ["z", "w"]).where("scope = 'ALL'").collect()}
    m = clean(rows, "ALL", [1, 2, 4, 3])
    Z = np.column_stack([np.ones(len(m)), m[:, 2:]])
    X = np.column_stack([np.ones(len(m)), m[:, 1]])
    P = Z @ np.linalg.lstsq(Z, X, rcond=None)[0]
    beta = np.linalg.lstsq(P, m[:, 0], rcond=None)[0]
    assert got["x"] == pytest.approx(beta[1], rel=1e-6)


def test_band(data):
    rows, df = data
    out = models.lm_band(df, "g", {"m": ("x", "y")}, points=5).where("scope = 'AT'").orderBy("point").collect()
    m = clean(rows, "AT", [1, 2])
    y, x = m.T
    beta, se, e, s2 = numpy_ols(y, m[:, 1:])
    assert [r.x for r in out] == pytest.approx(list(np.linspace(x.min(), x.max(), 5)))
    for r in out:
        half = tails.t_quantile(0.95, len(m) - 2) * math.sqrt(s2 * (1 / len(m) + (r.x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
        assert r.fit == pytest.approx(beta[0] + beta[1] * r.x, rel=1e-6)
        assert r.high - r.low == pytest.approx(2 * half)
