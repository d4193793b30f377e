"""The data behind box plots, densities, binned scatters and bars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expr import finite, finite_sql, quoted
from hearthstat.operators.quantiles import describe_by, join_groups
from hearthstat.sources.stored import store


def within_limits(df: DataFrame, col: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Scale limits: rows outside them are dropped before any statistic, missing values as well."""
    x = F.col(col)
    if low is not None:
        df = df.where(x >= F.lit(float(low)))
    if high is not None:
        df = df.where(x <= F.lit(float(high)))
    return df


def _values(df: DataFrame, by: Sequence[str], value: str, stored: bool) -> DataFrame:
    """The groups and finite values of a column; read several times, so stored unless it is a scan already."""
    out = df.selectExpr(*map(quoted, by), f"{finite_sql(value)} AS __x").where("__x IS NOT NULL")
    return out if stored else store(out)


def box_stats(
    df: DataFrame, by: Sequence[str], value: str, coef: float = 1.5, stored: bool = False, **options
) -> DataFrame:
    """Hinges, whiskers and outlier count of a column per group.

    Hinges are quartiles. A whisker ends at the most extreme value within `coef` times the
    interquartile range of its hinge; values beyond are outliers. Infinite values are left out.
    """
    by = list(by)
    source = _values(df, by, value, stored)
    stats = {"__x": [0.25, "median", 0.75]}
    found = describe_by(source, by, stats, count="n", stored=True, fences={"__x": coef}, **options)
    return found.select(
        *by,
        "n",
        F.col("lower_whisker___x").alias("lower_whisker"),
        F.col("p25___x").alias("lower_hinge"),
        F.col("median___x").alias("middle"),
        F.col("p75___x").alias("upper_hinge"),
        F.col("upper_whisker___x").alias("upper_whisker"),
        F.col("n_outliers___x").alias("n_outliers"),
    )


def bar_counts(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def bin2d(
    df: DataFrame, by: Sequence[str], x: str, y: str, width_x: float, width_y: float,
    origin: tuple[float, float] = (0.0, 0.0), name: str = "n", most: int | None = None,
) -> DataFrame:
    """Scatter of two columns as counts in rectangles; rows missing x or y are left out.

    With `most`, a group that has more rectangles gets that many at most: rectangles are merged, four by four, where there are
    few rows, and `level` tells how often their sides were doubled.
    """
    def bin_of(c: str, start: float, width: float) -> Column:
        return F.floor((finite(c) - F.lit(float(start))) / F.lit(float(width)))

    binned = df.select(
        *by, bin_of(x, origin[0], width_x).alias("bin_x"), bin_of(y, origin[1], width_y).alias("bin_y")
    ).where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
    cells = binned.groupBy(*by, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias(name))
    if most is not None:
        cells = _merged_cells(cells, list(by), name, most)
    times = F.pow(F.lit(2.0), F.col("level")) if most is not None else F.lit(1.0)
    return cells.withColumn("x", F.lit(float(origin[0])) + (F.col("bin_x") + 0.5) * F.lit(float(width_x)) * times).withColumn(
        "y", F.lit(float(origin[1])) + (F.col("bin_y") + 0.5) * F.lit(float(width_y)) * times
    )


def _merged_cells(cells: DataFrame, by: list[str], name: str, most: int) -> DataFrame:
    """At most so many cells per group: `level` tells how often a cell's sides were doubled.

    A square of four cells is one cell of the next level. A cell is divided into its four only if it has more than a certain
    part of the group's rows. At each level few cells have, so that their number is bounded whatever the spread; the
    fine cells of dense places stay, and every row stays in a cell. A group of few cells is left as it is.
    """
    if most < 8:
        raise ValueError("at least eight cells are needed")
    fine = store(cells)
    # Cells of both signs never meet, so that a group ends as up to four of them: all coordinates are 0 or -1.
    reach = F.greatest(*[F.greatest(F.col(c), -F.col(c) - 1) for c in ("bin_x", "bin_y")])
    sizes = fine.groupBy(*by).agg(F.count(F.lit(1)).alias("__cells"), F.sum(name).alias("__rows"), F.max(reach).alias("__reach"))
    height = F.when(F.col("__cells") > most, F.char_length(F.bin("__reach"))).otherwise(0)
    limit = F.when(F.col("__cells") > most, F.col("__rows") * 4.0 * (height + 1) / (most - 4)).otherwise(-1.0)
    sizes = store(sizes.select(*by, height.alias("__height"), limit.alias("__limit")))
    known = join_groups(fine, sizes, by) if by else fine.select("*", *[F.lit(value).alias(c) for c, value in sizes.first().asDict().items()])
    levels = known.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__height"))))
    shifted = [F.expr(f"shiftright({c}, level)").alias(c) for c in ("bin_x", "bin_y")]
    counts = levels.select(*by, "level", *shifted, name, "__height", "__limit").groupBy(*by, "level", "bin_x", "bin_y")
    counts = store(counts.agg(F.sum(name).alias(name), F.first("__height").alias("__height"), F.first("__limit").alias("__limit")))
    divided = counts.where(F.col(name) > F.col("__limit")).select(
        *[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)], (F.col("level") - 1).alias("__below"), F.col("bin_x").alias("__x"), F.col("bin_y").alias("__y")
    )
    # A cell that is not divided itself, of one that is.
    ends = counts.where((F.col(name) <= F.col("__limit")) | (F.col("level") == 0))
    same = [ends[c].eqNullSafe(divided[f"__of_{i}"]) for i, c in enumerate(by)]
    same += [F.col("level") == F.col("__below"), F.shiftright("bin_x", 1) == F.col("__x"), F.shiftright("bin_y", 1) == F.col("__y")]
    top = ends.where(F.col("level") == F.col("__height"))
    inner = ends.where(F.col("level") < F.col("__height")).join(divided, reduce(and_, same), "left_semi")
    return top.union(inner).select(*by, "level", "bin_x", "bin_y", name)


def kernel_density(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: int = 512,
    bins: int = 1024,
    stored: bool = False,
    **options,
) -> DataFrame:
    """Gaussian kernel density of a column per group, on an even grid over the group's range.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5). Rows are first split linearly between the two
    nearest of `bins` + 1 even points, so the kernel is summed over bins and its cost does not grow
    with the rows. A group of one value has no density.
    """
    by = list(by)
    source = _values(df, by, value, stored)
    stats = describe_by(source, by, {"__x": ["n", "sd", "min", "max", 0.25, 0.75]}, stored=True, **options)
    iqr = (F.col("p75___x") - F.col("p25___x")) / F.lit(1.34)
    spread = F.when(iqr > 0, F.least(F.col("sd___x"), iqr)).otherwise(F.col("sd___x"))
    stats = store(
        stats.where(F.col("max___x") > F.col("min___x")).select(
            *by,
            F.col("n___x").alias("n"),
            F.col("min___x").alias("x0"),
            ((F.col("max___x") - F.col("min___x")) / F.lit(bins)).alias("width"),
            ((F.col("max___x") - F.col("min___x")) / F.lit(points - 1)).alias("step"),
            (F.lit(0.9) * spread * F.pow(F.col("n___x").cast("double"), F.lit(-0.2))).alias("bandwidth"),
        )
    )
    at = (F.col("__x") - F.col("x0")) / F.col("width")
    cell = F.least(F.floor(at), F.lit(bins - 1))
    counts = (
        join_groups(source, stats.select(*by, "x0", "width"), by)
        .select(*by, cell.alias("cell"), (at - cell).alias("part"))
        .groupBy(*by, "cell")
        .agg(F.sum(1 - F.col("part")).alias("left"), F.sum("part").alias("right"))
    )
    # (groups x bins) rows, then one row per group with the masses of its nodes, folded at each point of the grid.
    held = F.collect_list(F.struct("cell", "left", "right")).alias("cells")
    folded = join_groups(counts.groupBy(*by).agg(held) if by else counts.agg(held), stats, by)

    def node(number: Column, mass: Column, x: Column) -> Column:
        z = (x - (F.col("x0") + number * F.col("width"))) / F.col("bandwidth")
        return mass * F.exp(F.lit(-0.5) * z * z)

    def density(x: Column) -> Column:
        total = F.aggregate(
            "cells", F.lit(0.0), lambda t, c: t + node(c["cell"], c["left"], x) + node(c["cell"] + 1, c["right"], x)
        )
        return total / (F.lit(2.5066282746310002) * F.col("bandwidth") * F.col("n"))

    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda p: F.struct(p.alias("point"), (F.col("x0") + p * F.col("step")).alias("x")))
    filled = F.transform(grid, lambda g: F.struct(g["point"].alias("point"), g["x"].alias("x"), F.col("bandwidth").alias("bandwidth"), density(g["x"]).alias("density")))
    return folded.select(*by, F.inline(filled))
