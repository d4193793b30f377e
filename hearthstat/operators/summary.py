"""Grouped summaries, frequency tables and data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hearthstat.functions.expr import level_index
from hearthstat.operators.quantiles import describe_by


def level_grid(base: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Each row of a small table repeated for every combination of the declared levels."""
    for name, values in levels.items():
        base = base.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return base


def one_row(df: DataFrame) -> DataFrame:
    """A table of one row and no columns, to start a level grid from."""
    return df.sparkSession.range(1).select()


def null_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing values per column: count and share, one row per column (and group)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)]]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"n_{i}").alias("present")) for i, c in enumerate(cols)]
    missing = F.col("n_rows") - F.col("present")
    return wide.select(*by, "n_rows", F.inline(F.array(*rows))).select(
        *by, "variable", "n_rows", missing.alias("n_missing"), F.try_divide(missing, "n_rows").alias("share_missing")
    )


def six_numbers(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count: one row per column."""
    stats = ["min", 0.25, "median", "mean", 0.75, "max", "n"]
    wide = describe_by(df, [], {c: stats for c in cols}, count="n_rows", **options)
    rows = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"min_{c}").alias("minimum"),
            F.col(f"p25_{c}").alias("q1"),
            F.col(f"median_{c}").alias("median"),
            F.col(f"mean_{c}").alias("mean"),
            F.col(f"p75_{c}").alias("q3"),
            F.col(f"max_{c}").alias("maximum"),
            (F.col("n_rows") - F.col(f"n_{c}")).alias("n_missing"),
        )
        for c in cols
    ]
    return wide.select(F.inline(F.array(*rows)))


def frequency(df: DataFrame, col: str, levels: Sequence, name: str = "n") -> DataFrame:
    """Rows per level in level order; the missing level is shown if it occurs."""
    return crosstab(df, {col: levels}, name)


def crosstab(df: DataFrame, levels: Mapping[str, Sequence], name: str = "n") -> DataFrame:
    """Rows per combination of declared levels, zero cells included.

    A value outside the levels counts as missing. The missing level of a dimension is shown only if
    some row has it. `order_*` columns carry the level order, the missing level last.
    """
    dims = list(levels)
    coded = df.select(*[F.when(F.col(d).isin(*levels[d]), F.col(d)).alias(d) for d in dims])
    cells = coded.groupBy(*dims).agg(F.count(F.lit(1)).alias(name))
    grid = level_grid(one_row(df), {f"__{d}": [*levels[d], None] for d in dims})
    on = [grid[f"__{d}"].eqNullSafe(cells[d]) for d in dims]
    full = grid.join(cells, on, "left").select(
        *[F.col(f"__{d}").alias(d) for d in dims], F.coalesce(F.col(name), F.lit(0)).alias(name)
    )
    for d in dims:
        in_level = F.sum(name).over(Window.partitionBy(d))
        full = full.withColumn(f"in_{d}", in_level)
    for d in dims:
        full = full.where(F.col(d).isNotNull() | (F.col(f"in_{d}") > 0))
    order = [F.coalesce(level_index(d, levels[d]), F.lit(len(levels[d]) + 1)).alias(f"order_{d}") for d in dims]
    return full.select(*dims, name, *order)


def extreme_profile(profile: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The rows of a summary table with the largest and smallest value of each measure, ties kept.

    Works on aggregated rows: one window partition per measure and group of `by`.
    """
    ids = [c for c in profile.columns if c not in set(measures)]
    long = profile.unpivot(ids, list(measures), "measure", "value").where(F.col("value").isNotNull())
    w = Window.partitionBy(*by, "measure")
    top, bottom = F.max("value").over(w), F.min("value").over(w)
    ends = F.filter(
        F.array(F.when(F.col("value") == F.col("top"), "max"), F.when(F.col("value") == F.col("bottom"), "min")),
        lambda e: e.isNotNull(),
    )
    return (
        long.withColumns({"top": top, "bottom": bottom})
        .withColumn("extreme", F.explode(ends))
        .drop("top", "bottom")
    )


def value_range(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value, missing ones skipped."""
    aggs = [F.min(col).alias("lowest"), F.max(col).alias("highest")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
