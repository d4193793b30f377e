import math
import random

import numpy as np
import pytest

from hearthstat.operators import layers, quantiles
from hearthstat.sources.stored import store


def brute_box(xs):
    q1, q2, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
    inside = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    return (len(xs), min(inside), q1, q2, q3, max(inside), len(xs) - len(inside))


@pytest.mark.parametrize("options", [{}, {"bracket_rows": 3, "slices": 4}, {"accuracy": 2}, {"accuracy": 50, "bracket_rows": 1, "slices": 3}])
def test_box_stats(spark, options):
    rng = random.Random(4)
    data = {
        "plain": [rng.random() for _ in range(101)],
        "one_side": [1.0, 2.0, 3.0, 4.0, 100.0],
        "both": [-100.0, 1.0, 2.0, 3.0, 4.0, 5.0, 100.0],
        "same": [2.0] * 6,
        "long": [math.exp(rng.gauss(0, 3)) * rng.choice([-1, 1]) for _ in range(3000)],
        "spike": [1.0] * 900 + [rng.random() * 50 for _ in range(300)],
        None: [1.0, 5.0],
    }
    rows = [(g, x) for g, xs in data.items() for x in xs] + [("plain", None), ("one_side", float("inf")), ("gone", None)]
    out = layers.box_stats(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", **options)
    got = {r.g: tuple(r)[1:] for r in out.collect()}
    assert set(got) == set(data)
    for g, xs in data.items():
        assert got[g] == pytest.approx(brute_box(xs))


def test_whiskers_take_no_third_scan(spark, monkeypatch):
    """Values beside the fences leave the second scan already."""
    for name in ("_cells", "_reread"):
        monkeypatch.setattr(quantiles, name, lambda *a: pytest.fail("a third scan"))
    df = store(spark.range(120_000).selectExpr("string(id % 2) AS g", "tan((id * 7919 % 120000 - 60000) / 40000D) AS v"))
    for r in layers.box_stats(df, ["g"], "v", stored=True).collect():
        xs = [math.tan((i * 7919 % 120_000 - 60_000) / 40_000) for i in range(120_000) if i % 2 == int(r.g)]
        assert tuple(r)[1:] == pytest.approx(brute_box(xs), rel=1e-12)
    with pytest.raises(ValueError):
        quantiles.describe_by(df, ["g"], {"v": ["median"]}, fences={"v": 1.5})


def merged(cells, most):
    """Cells (x, y) -> rows, divided from the top as long as one has more than its part."""
    if len(cells) <= most:
        return {(0, *k): n for k, n in cells.items()}
    height = max(max(v, -v - 1) for k in cells for v in k).bit_length() or 1
    limit = sum(cells.values()) * 4.0 * (height + 1) / (most - 4)
    out = {}

    def walk(level, at):
        mine = {k: n for k, n in cells.items() if (k[0] >> level, k[1] >> level) == at}
        if not mine:
            return
        if level and sum(mine.values()) > limit:
            for dx in (0, 1):
                for dy in (0, 1):
                    walk(level - 1, (2 * at[0] + dx, 2 * at[1] + dy))
        else:
            out[level, *at] = sum(mine.values())

    for x in (-1, 0):
        for y in (-1, 0):
            walk(height, (x, y))
    return out


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("most", [8, 60, 300])
def test_merged_bins(spark, most, by):
    rng = random.Random(12)
    rows = [("wide", rng.gauss(0, 1) * 10 ** rng.randint(0, 9), rng.gauss(0, 1) * 10 ** rng.randint(0, 6)) for _ in range(1500)]
    rows += [("dense", 10 + rng.random(), rng.random() * 3) for _ in range(2000)] + [("wide", -0.5, -0.5)] * 4000 + [(None, 3.0, 4.0), ("wide", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {}
    for r in layers.bin2d(df, by, "x", "y", 0.25, 0.5, most=most).collect():
        got.setdefault(r["g"] if by else 0, {})[r.level, r.bin_x, r.bin_y] = r.n
        assert (r.x, r.y) == ((r.bin_x + 0.5) * 0.25 * 2**r.level, (r.bin_y + 0.5) * 0.5 * 2**r.level)
    for g in got:
        cells = {}
        for k, x, y in rows:
            if x is not None and (k == g or not by):
                at = math.floor(x / 0.25), math.floor(y / 0.5)
                cells[at] = cells.get(at, 0) + 1
        assert got[g] == merged(cells, most)
        assert len(got[g]) <= most and sum(got[g].values()) == sum(cells.values())
    assert set(got) == ({"wide", "dense", None} if by else {0})


def test_merged_bins_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert layers.bin2d(df, ["g"], "x", "y", 1, 1, most=10).collect() == []
    assert layers.bin2d(df, [], "x", "y", 1, 1, most=10).collect() == []
    with pytest.raises(ValueError):
        layers.bin2d(df, ["g"], "x", "y", 1, 1, most=4)


def test_limits_drop_rows(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (9.0,), (None,)], "v double")
    assert sorted(r.v for r in layers.within_limits(df, "v", 0, 5).collect()) == [0.0, 5.0]
    assert layers.within_limits(df, "v").count() == 5


def test_density(spark):
    rng = random.Random(9)
    xs = [rng.gauss(10, 3) for _ in range(700)]
    rows = [("a", x) for x in xs] + [("flat", 1.0)] * 3
    out = layers.kernel_density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points=64).orderBy("point").collect()
    assert {r.g for r in out} == {"a"} and len(out) == 64
    iqr = np.subtract(*np.quantile(xs, [0.75, 0.25]))
    h = 0.9 * min(np.std(xs, ddof=1), iqr / 1.34) * len(xs) ** -0.2
    assert out[0].bandwidth == pytest.approx(h)
    exact = [np.mean(np.exp(-0.5 * ((r.x - np.array(xs)) / h) ** 2)) / (h * math.sqrt(2 * math.pi)) for r in out]
    assert [r.density for r in out] == pytest.approx(exact, rel=2e-3, abs=1e-6)
    step = out[1].x - out[0].x
    assert sum(r.density for r in out) * step == pytest.approx(1, abs=0.02)


def test_bins_and_bars(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 9.9, 4.9), ("a", -0.1, 5.0), ("a", None, 1.0), ("a", float("inf"), 1.0)], "g string, x double, y double")
    got = {(r.bin_x, r.bin_y): (r.n, r.x, r.y) for r in layers.bin2d(df, ["g"], "x", "y", 10, 5).collect()}
    assert got == {(0, 0): (2, 5.0, 2.5), (-1, 1): (1, -5.0, 7.5)}
    assert {(r.g, r.n) for r in layers.bar_counts(df, ["g"]).collect()} == {("a", 5)}
