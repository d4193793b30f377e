"""Exact grouped quantiles against numpy, with and without narrowing passes."""

import math
import random
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from hearthstat.operators import quantiles
from hearthstat.operators.quantiles import describe_by, quantile_values
from hearthstat.sources.stored import checkpoint_root, store, stored_tables

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def column_sets():
    rng = random.Random(7)
    return {
        "normal": [rng.gauss(0, 1e5) for _ in range(997)],
        "long_tail": [math.exp(rng.gauss(5, 4)) * rng.choice([-1, 1]) for _ in range(1000)],
        "ties": [float(rng.choice([0, 0, 0, 0, 1, 2, 50])) for _ in range(800)],
        "constant": [3.25] * 50,
        "one": [7.0],
        "two": [1.0, 2.0],
        "tight": [1e9 + i * 2.0**-20 for i in range(500)],
        # Clusters far below the width of a slice, next to far outliers.
        "clusters": [1.0 + i * 2.0**-50 for i in range(200)] + [1e12 + i for i in range(200)] + [-1e300, 1e300],
        "neighbours": [1.0, math.nextafter(1.0, 2)] * 40,
    }


@pytest.fixture(scope="module")
def grouped(spark):
    data = column_sets()
    rows = [(g, x) for g, xs in data.items() for x in xs]
    rows += [(g, None) for g in data] + [("empty", None)] + [(None, float(i)) for i in range(11)]
    random.Random(1).shuffle(rows)
    return data, store(spark.createDataFrame(rows, "g string, x double"))


@pytest.mark.parametrize(
    "options",
    [{}, {"bracket_rows": 20, "slices": 16}, {"bracket_rows": 1, "slices": 2}, {"accuracy": 20, "bracket_rows": 100, "slices": 8}, {"accuracy": 2}],
)
def test_grouped_quantiles_match_numpy(grouped, options):
    data, df = grouped
    out = describe_by(df, ["g"], {"x": [*PROBS, "median", "mean", "sd", "n"]}, count="rows", stored=True, **options)
    got = {r.g: r.asDict() for r in out.collect()}
    assert set(got) == {*data, "empty", None}
    for g, xs in {**data, None: [float(i) for i in range(11)]}.items():
        row = got[g]
        want = np.quantile(np.array(xs), PROBS)
        for p, w in zip(PROBS, want):
            assert row[f"p{p * 100:g}_x"] == pytest.approx(w, rel=1e-13, abs=1e-300), (g, p)
        assert row["median_x"] == row["p50_x"]
        assert row["n_x"] == len(xs)
        assert row["rows"] == len(xs) + (g is not None)
        if len(xs) == 1:
            assert row["sd_x"] is None
    assert all(got["empty"][c] is None for c in ("p50_x", "mean_x", "sd_x"))
    assert got["empty"]["rows"] == 1


def test_several_columns_and_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1, None]), rng.random(), rng.gauss(0, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x string, col int, slice double, rank double")
    out = describe_by(df, ["x", "col"], {"slice": [0.2], "rank": ["median"]}, bracket_rows=5, slices=8)
    assert out.columns == ["x", "col", "p20_slice", "median_rank"]
    for r in out.collect():
        mine = [q for q in rows if q[0] == r.x and q[1] == r.col]
        assert r.p20_slice == pytest.approx(np.quantile([q[2] for q in mine], 0.2), rel=1e-12)
        assert r.median_rank == pytest.approx(np.median([q[3] for q in mine]), rel=1e-12)


@pytest.mark.parametrize("bracket_rows", [100, 2])
def test_infinite_and_nan_values(spark, bracket_rows):
    xs = [1.0, 2.0, 3.0, float("inf"), float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    kept = describe_by(df, [], {"x": [0.5, "max", "mean", "n"]}, bracket_rows=bracket_rows).first()
    assert (kept.p50_x, kept.max_x, kept.mean_x, kept.n_x) == (2.0, 3.0, 2.0, 3)
    whole = describe_by(df, [], {"x": [0.0, 0.5, 1.0, "n"]}, finite_only=False, bracket_rows=bracket_rows).first()
    assert (whole.p0_x, whole.p50_x, whole.p100_x, whole.n_x) == (float("-inf"), 2.5, float("inf"), 6)


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert describe_by(df, ["g"], {"x": [0.5]}).collect() == []
    assert quantile_values(df, {"x": [0.5]}) == {("x", 0.5): None}


def test_moments_alone_take_one_lazy_pass(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, x double")
    got = {r.g: (r.mean_x, r.sum_x) for r in describe_by(df, ["g"], {"x": ["mean", "sum"]}).collect()}
    assert got == {"a": (2.0, 4.0), "b": (None, None)}


@pytest.mark.parametrize("sign", [1, -1])
def test_values_of_all_magnitudes(spark, sign):
    """Powers of two near 0 narrow as fast as any others."""
    xs = [sign * 2.0**-k for k in range(1, 1001)]
    df = store(spark.createDataFrame([(x,) for x in xs], "x double"))
    got = describe_by(df, [], {"x": [0.01, 0.5, 0.999]}, bracket_rows=5, stored=True).first()
    for p, value in ((0.01, got.p1_x), (0.5, got.p50_x), (0.999, got.p99_9_x)):
        assert value == pytest.approx(np.quantile(xs, p), rel=1e-12)


def weighted_quantile(pairs, p):
    """The smallest value at which the cumulated weight reaches its part of the whole."""
    pairs = sorted(pairs)
    whole, total = sum(w for _, w in pairs), 0.0
    for x, w in pairs:
        total += w
        if total >= p * whole * (1 - 1e-12):
            return x


def weighted_rows():
    rng = random.Random(11)
    rows = []
    for g, xs in column_sets().items():
        rows += [(g, x, rng.choice([0.5, 1.0, 3.25, 40.0, 1e-3]), rng.choice([1, 2, 3, None])) for x in xs if abs(x) < 1e100]
    bad = [(g, 9e99, w, 1) for g in ("normal", "ties") for w in (0.0, -3.0, None, float("nan"), float("inf"))]
    none = [("normal", None, 5.0, 1), ("normal", float("inf"), 5.0, 1), ("no weight", 1.0, None, 1)]
    return rows + bad + none + [(None, float(i), 1.0 + i, 1) for i in range(9)]


def weighted_expected(pairs):
    n, whole = len(pairs), sum(w for _, w in pairs)
    mean = sum(x * w for x, w in pairs) / whole
    var = sum(w * (x - mean) ** 2 for x, w in pairs) / whole * n / (n - 1) if n > 1 else None
    out = {f"p{p * 100:g}_x": weighted_quantile(pairs, p) for p in PROBS}
    return out | {"mean_x": mean, "var_x": var, "sd_x": var and var**0.5, "sum_x": sum(x * w for x, w in pairs), "n_x": n,
                  "min_x": min(pairs)[0], "max_x": max(pairs)[0], "median_x": weighted_quantile(pairs, 0.5)}


WEIGHTED = [*PROBS, "median", "mean", "var", "sd", "sum", "n", "min", "max"]


def close(got, want):
    assert (got is None) == (want is None)
    assert want is None or got == pytest.approx(want, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("options", [{}, {"bracket_rows": 20, "slices": 16}, {"bracket_rows": 1, "slices": 2}])
def test_weighted_statistics(spark, options):
    rows = weighted_rows()
    df = spark.createDataFrame(rows, "g string, x double, w double, im int").repartition(5)
    got = {r.g: r for r in describe_by(df, ["g"], {"x": WEIGHTED}, count="rows", weight="w", **options).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, row in got.items():
        pairs = [(x, w) for k, x, w, _ in rows if k == g and x is not None and math.isfinite(x) and w is not None and 0 < w < float("inf")]
        assert row.rows == sum(r[0] == g for r in rows)
        if not pairs:
            assert row.n_x == 0 and all(row[c] is None for c in ("mean_x", "var_x", "median_x", "p99_x"))
            continue
        for c, want in weighted_expected(pairs).items():
            close(row[c], want)


def test_equal_weights_give_the_inverse_distribution(spark):
    df = spark.createDataFrame([(float(i), 0.1) for i in range(1, 11)], "x double, w double")
    row = describe_by(df, [], {"x": [0.0, 0.1, 0.3, 0.5, 0.51, 1.0]}, weight="w").first()
    # 0.1 summed up three or five times is not 0.3 or 0.5 to the last bit.
    assert (row.p0_x, row.p10_x, row.p30_x, row.p50_x, row.p51_x, row.p100_x) == (1, 1, 3, 5, 6, 10)


@pytest.mark.parametrize("weight", ["w", None])
def test_averages_over_implicates(spark, weight):
    rows = [r for r in weighted_rows() if r[0] in ("normal", "ties", "one", None)] + [("late", 4.0, 2.0, 3), ("late", 8.0, 2.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, w double, im int")
    stats = ["mean", "median", 0.25, "sd", "n", "sum"]
    out = describe_by(df, ["g"], {"x": stats}, count="rows", weight=weight, by_implicate="im")
    each = describe_by(df.where("im IS NOT NULL"), ["g", "im"], {"x": stats}, count="rows", weight=weight).collect()
    assert out.columns == ["g", "mean_x", "median_x", "p25_x", "sd_x", "n_x", "sum_x", "rows"]
    for r in out.collect():
        mine = [e for e in each if e.g == r.g]
        for c in out.columns[1:]:
            have = [e[c] for e in mine if e[c] is not None]
            whole = c in ("n_x", "sum_x", "rows")
            want = sum(have) / (3 if whole else len(have)) if have else None
            assert (r[c] is None) == (want is None) and (want is None or r[c] == pytest.approx(want, rel=1e-12))


def test_empty_table_with_weights(spark):
    df = spark.createDataFrame([], "g string, x double, w double, im int")
    assert describe_by(df, ["g"], {"x": [0.5, "sd"]}, weight="w").collect() == []
    row = describe_by(df, [], {"x": [0.5, "sd", "mean", "n"]}, weight="w").first()
    assert (row.p50_x, row.sd_x, row.mean_x, row.n_x) == (None, None, None, 0)
    assert describe_by(df, ["g"], {"x": [0.5]}, weight="w", by_implicate="im").collect() == []


def test_two_scans_where_the_sketch_is_good(spark, monkeypatch):
    """The second search would be made by `_cells`: it is not needed, whatever the distribution, and few rows leave the scan."""
    left = []
    counted = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda rows, *more: left.append(counted(rows, *more)) or left[-1])
    monkeypatch.setattr(quantiles, "_cells", lambda *a: pytest.fail("a third scan"))
    df = store(spark.range(200_000).selectExpr("id % 3 AS g", "exp((id * 7919 % 200000) / 9000D) AS x", "double(id % 5) AS y"))
    out = describe_by(df, ["g"], {"x": [0.1, 0.5, 0.99], "y": ["median"]}, stored=True).collect()
    for r in out:
        xs = [math.exp((i * 7919 % 200000) / 9000) for i in range(200_000) if i % 3 == r.g]
        assert [r.p10_x, r.p50_x, r.p99_x] == pytest.approx(np.quantile(xs, [0.1, 0.5, 0.99]).tolist(), rel=1e-12)
        assert r.median_y == 2.0
    assert left[0].count() < 600


def test_unknown_statistic(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        describe_by(df, [], {"x": ["mode"]})


def test_hot_group_is_not_gathered(spark):
    """No exchange of the final plan carries the rows of a group: they are counted before."""
    df = store(spark.range(20_000).selectExpr("'a' AS g", "double(id * 7919 % 20000) AS x"))
    out = describe_by(df, ["g"], {"x": [0.5]}, stored=True, bracket_rows=50)
    assert out.first().p50_x == 9999.5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "CartesianProduct" not in plan


def test_store_uses_the_session_folder(spark):
    root = checkpoint_root(spark)
    assert spark.conf.get("spark.checkpoint.dir", root) == root
    stored = store(spark.range(5))
    assert root in stored.inputFiles()[0] and stored.count() == 5


def test_no_machine_local_folder_on_a_cluster():
    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert checkpoint_root(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    for master in ("local", "local[2]", "local[*]"):
        assert checkpoint_root(session(master, None)) == checkpoint_root(session("local[2]", None))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            checkpoint_root(session(master, None))


def test_a_scope_frees_its_tables(spark):
    kept = store(spark.range(3))
    with stored_tables(spark):
        df = spark.createDataFrame([(float(i % 7),) for i in range(300)], "x double")
        out = describe_by(df, [], {"x": [0.5]}, bracket_rows=5)
        inside = [f for f in out.inputFiles() if checkpoint_root(spark) in f]
        assert inside and out.first().p50_x == 3.0
    assert not any(Path(f.removeprefix("file:").removeprefix("//")).exists() for f in inside)
    assert kept.count() == 3
    with pytest.raises(ZeroDivisionError), stored_tables(spark):
        files = store(spark.range(2)).inputFiles()
        raise ZeroDivisionError
    assert not any(Path(f.removeprefix("file:").removeprefix("//")).exists() for f in files)
