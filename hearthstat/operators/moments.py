"""Means and centred cross products of variable pairs, per group and pooled.

One scan gives the moments of every group; the pooled moments follow from them on a handful of rows, so
a statistic for all rows and for each country costs no second scan and no repeated rows. Squares of money
amounts are large: products are centred while they are summed, never as sum(xy) - n mean mean.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from hearthstat.functions.expr import finite_sql, quoted, valid_sql

POOLED = "ALL"


def scope_name(by: str) -> str:
    """The group as a scope; a group that has the name of the pooled result is put in quotes."""
    return f"CASE WHEN string({quoted(by)}) = '{POOLED}' THEN '\"{POOLED}\"' ELSE string({quoted(by)}) END"


def pair_moments(
    df: DataFrame, by: str, pairs: Mapping[str, tuple[str, str]], finite_only: bool = True
) -> DataFrame:
    """Moments of named (x, y) pairs per group over the rows where both are present.

    Columns: the group, `pair`, `n`, `n_dropped`, `mean_x`, `mean_y`, `sxx`, `syy`, `sxy` and the ranges
    `min_x`, `max_x`, `min_y`, `max_y`, which tell a constant from rounding noise in `sxx`.
    Each row feeds its pairs to the aggregate one after the other, under a small number as the pair's key;
    partial sums leave a task as one row per group and pair.
    """
    valid = finite_sql if finite_only else valid_sql
    items = ", ".join(
        f"named_struct('pair', {i}, 'x', {valid(x)}, 'y', {valid(y)})" for i, (x, y) in enumerate(pairs.values())
    )
    long = df.selectExpr(quoted(by), f"inline(array({items}))").selectExpr(
        quoted(by), "pair", "CASE WHEN y IS NOT NULL THEN x END AS x", "CASE WHEN x IS NOT NULL THEN y END AS y"
    )
    aggs = [
        "count(x) AS n",
        "count(1) - count(x) AS n_dropped",
        "avg(x) AS mean_x",
        "avg(y) AS mean_y",
        "var_pop(x) * count(x) AS sxx",
        "var_pop(y) * count(x) AS syy",
        "covar_pop(x, y) * count(x) AS sxy",
        "min(x) AS min_x",
        "max(x) AS max_x",
        "min(y) AS min_y",
        "max(y) AS max_y",
    ]
    names = ", ".join(f"'{name}'" for name in pairs)
    out = long.groupBy(by, "pair").agg(*map(F.expr, aggs))
    return out.selectExpr(quoted(by), f"array({names})[pair] AS pair", *out.columns[2:])


SLOTS = 1024  # parts of the pooled result, merged one by one before they are merged with each other


def _merged() -> str:
    """SQL text: the moments of a list of parts, each about its own means, as those of the whole about the common means."""
    n = "(a.n + b.n)"
    cross = {"sxx": ("x", "x"), "syy": ("y", "y"), "sxy": ("x", "y")}
    means = ", ".join(f"'mean_{v}', a.mean_{v} + (b.mean_{v} - a.mean_{v}) * b.n / {n}" for v in "xy")
    sums = ", ".join(
        f"'{s}', a.{s} + b.{s} + (b.mean_{v} - a.mean_{v}) * (b.mean_{w} - a.mean_{w}) * a.n * b.n / {n}" for s, (v, w) in cross.items()
    )
    none = "named_struct('n', 0L, 'mean_x', 0D, 'mean_y', 0D, 'sxx', 0D, 'syy', 0D, 'sxy', 0D)"
    return f"aggregate(parts, {none}, (a, b) -> CASE WHEN b.n = 0 THEN a WHEN a.n = 0 THEN b ELSE named_struct('n', {n}, {means}, {sums}) END)"


def with_pooled(moments: DataFrame, by: str, name: str = "scope") -> DataFrame:
    """Moments per group and for all groups together; `scope` is the group or ALL.

    A missing group counts in ALL only; a group of that name is in quotes. For the aggregated rows of the function above,
    of which there may be millions: the pooled result is merged in two levels, first within slots of the groups, so
    that no task gets them all.
    """
    how = {"n_dropped": "sum", "min_x": "min", "max_x": "max", "min_y": "min", "max_y": "max"}
    extra = [f"{f}({c}) AS {c}" for c, f in how.items() if c in moments.columns]
    values = ["n", "mean_x", "mean_y", "sxx", "syy", "sxy"]
    scopes = moments.selectExpr(
        f"explode(array_compact(array({scope_name(by)}, '{POOLED}'))) AS {name}", f"pmod(xxhash64({quoted(by)}), {SLOTS}) AS slot",
        *[c for c in moments.columns if c != by],
    )
    part = f"named_struct({', '.join(f'{v!r}, {v}' for v in values)})"
    gathered = [F.expr(f"collect_list({part}) AS parts"), *map(F.expr, extra)]
    kept = [c for c in how if c in moments.columns]
    slots = scopes.groupBy(name, "slot", "pair").agg(*gathered).selectExpr(name, "pair", f"inline(array({_merged()}))", *kept)
    whole = slots.groupBy(name, "pair").agg(*gathered).selectExpr(name, "pair", f"inline(array({_merged()}))", *kept)
    return whole.selectExpr(name, "pair", "n", *[f"CASE WHEN n > 0 THEN {v} END AS {v}" for v in values[1:]], *kept)
