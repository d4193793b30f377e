"""Exact quantiles of groups of any size, with or without weights.

The built-in exact percentile keeps every distinct value of a group in one task. Here a group is never
gathered. The scan that takes the moments also keeps a mergeable rank sketch of each column, and the sketch gives
a narrow range of values around each wanted rank. A second scan counts the rows below, between and above these
ranges (partial sums before a shuffle of counts) and lets only the values inside them out, counted by value. The
counts tell which value has the wanted rank: the sketch is never trusted, and a rank that it has missed lies in
one of the other ranges, whose rows were counted as well.

A range that holds more than `bracket_rows` rows, or that the sketch has missed, is narrowed in further scans: its rows are
counted in slices, and the slice that holds the rank is the next range. A range that spans magnitudes is sliced by the
logarithm, a narrower one by value. Doubles have some 2,900 units of signed logarithm and 2^53 values within
one of them, so that one scan and at most five more reach single values whatever the distribution.

With weights the search is on cumulated weight instead of rank. There is no weighted sketch: it starts with the whole
range of the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from hearthstat.functions.expr import finite_sql, quoted, valid_sql
from hearthstat.sources.stored import store

BRACKET_ROWS = 250_000  # most rows that one bracket may bring to one task
SLICES = 4096  # slices of one bracket in one narrowing pass
ACCURACY = 10_000  # the sketch is off by one in so many ranks at most
MARGINS = (0.001, 0.01, 0.1)  # wider ranges around a wanted rank, for groups of few rows
REACHED = 1e-12  # part of the whole weight by which a sum of weights may be off

MOMENTS = {"mean": "avg", "sd": "stddev_samp", "var": "var_samp", "min": "min", "max": "max", "sum": "sum", "n": "count"}
INF = "double('infinity')"


def join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of a stored one-row-per-group table; a missing key matches a missing key.

    The join carries no hint: Spark broadcasts the stored table if its size allows, and otherwise
    shuffles and splits hot groups.
    """
    names = {k: f"__by_{i}" for i, k in enumerate(by)}
    right = groups.withColumnsRenamed(names)
    conds = [df[k].eqNullSafe(right[n]) for k, n in names.items()]
    return df.join(right, reduce(and_, conds), how).drop(*names.values())


def describe_by(
    df: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, Sequence[str | float]],
    count: str | None = None,
    finite_only: bool = True,
    bracket_rows: int = BRACKET_ROWS,
    slices: int = SLICES,
    stored: bool = False,
    weight: str | None = None,
    by_implicate: str | None = None,
    accuracy: int = ACCURACY,
    fences: Mapping[str, float] | None = None,
) -> DataFrame:
    """Statistics of columns per group, one row per group, the group of a missing key included.

    `measures` maps a column to statistics: "mean", "median", "sd", "var", "min", "max", "sum", "n"
    or a probability for a quantile with linear interpolation between order statistics. Results are named
    `mean_col`, `median_col`, ..., and `p25_col` for 0.25. Missing values are skipped; infinite ones
    too unless `finite_only` is off. `count` names a column for the number of rows. With `stored` the
    input is a plain scan and is not written again.

    With `weight`, values of rows whose weight is missing, infinite or not positive are skipped. The mean and the sum are
    weighted; the variance is the weighted mean square about the weighted mean times n / (n - 1); a quantile is the
    smallest value at which the cumulated weight reaches its part of the whole. "n" stays the number of values.

    With `by_implicate`, statistics are taken in each implicate of that column and averaged over the implicates in which the
    group has them; sums and counts are averaged over all implicates. Rows without an implicate belong to none.

    `fences` asks for `lower_whisker_col`, `upper_whisker_col` and `n_outliers_col` of columns whose quartiles are wanted: the
    most extreme values within so many interquartile ranges of the quartiles, and the number of values beyond. The
    ranges around the quartiles give one around each fence, whose values leave the same scan; only a range of rows that a
    fence turns out to cut is read again. Not for weights or implicates.
    """
    options = {"finite_only": finite_only, "bracket_rows": bracket_rows, "slices": slices, "weight": weight, "accuracy": accuracy}
    if fences and (weight or by_implicate or not all({0.25, 0.75} <= set(measures[c]) for c in fences)):
        raise ValueError("fences need both quartiles, and neither weights nor implicates")
    if by_implicate:
        part = df.where(F.col(by_implicate).isNotNull())
        each = store(describe_by(part, [*by, by_implicate], measures, count, **options))
        return _over_implicates(each, by, measures, count, by_implicate)
    cols = list(measures)
    by = {f"__k{i}": quoted(k) for i, k in enumerate(by)}  # keys of any name
    probs = {
        i: {stat_name(s, c): _probability(s) for s in measures[c] if s not in MOMENTS} for i, c in enumerate(cols)
    }
    ranked = any(probs.values())
    spread = weight is not None and any(s in ("sd", "var") for c in cols for s in measures[c])
    valid = finite_sql if finite_only else valid_sql
    if weight:
        w = f"double({quoted(weight)})"
        df = df.selectExpr("*", f"CASE WHEN {w} > 0 AND {w} < {INF} THEN {w} END AS __w")
        numbers = ["__w", *[f"CASE WHEN __w IS NOT NULL THEN {valid(c)} END AS __v{i}" for i, c in enumerate(cols)]]
    else:
        numbers = [f"{valid(c)} AS __v{i}" for i, c in enumerate(cols)]
    source = df.selectExpr(*[f"{k} AS {name}" for name, k in by.items()], *numbers)
    if (ranked or spread) and not stored:
        source = store(source)

    keys = list(by) or ["__all"]
    aggs = [] if by else ["0 AS __all"]
    for i, c in enumerate(cols):
        if probs[i]:
            aggs += [f"count(__v{i}) AS n_{i}", f"min(__v{i}) AS lo_{i}", f"max(__v{i}) AS hi_{i}"]
            real = f"CASE WHEN abs(__v{i}) < {INF} THEN __v{i} END"
            aggs += [f"min({real}) AS flo_{i}", f"max({real}) AS fhi_{i}"] if not finite_only else []
            if weight:
                aggs.append(f"sum(CASE WHEN __v{i} IS NOT NULL THEN __w END) AS w_{i}")
            else:
                near = ", ".join(f"{p!r}D" for p in _near(probs[i].values(), accuracy))
                aggs.append(f"percentile_approx(__v{i}, array({near}), {accuracy}) AS sketch_{i}")
        aggs += [f"{_moment(s, i, weight)} AS {quoted(stat_name(s, c))}" for s in measures[c] if s in MOMENTS]
        if spread and any(s in ("sd", "var") for s in measures[c]):
            aggs += [f"{_moment('mean', i, weight)} AS mid_{i}", f"count(__v{i}) AS count_{i}"]
    if count:
        aggs.append(f"count(1) AS {quoted(count)}")
    base = source.groupBy(*by).agg(*map(F.expr, aggs))
    names = [f"{name} AS {k}" for name, k in by.items()]
    order = [quoted(stat_name(s, c)) for c in cols for s in measures[c]]
    order += [quoted(f"{name}_{c}") for c in fences or () for name in WHISKERS]
    order += [quoted(count)] if count else []
    if not ranked and not spread:
        return base.selectExpr(*names, *order)

    base = store(base.selectExpr("*", "monotonically_increasing_id() AS __group"))  # numbers fixed by the write
    named = {}
    both = base
    if spread:
        both, squares = _with_squares(source, both, list(by), [i for i, c in enumerate(cols) if f"mid_{i}" in base.columns])
        for i, c in enumerate(cols):
            named |= {quoted(stat_name(s, c)): squares(s, i) for s in measures[c] if s in ("sd", "var")}
    if ranked:
        coefs = {cols.index(c): float(x) for c, x in (fences or {}).items()}
        positions, cells = _order_statistics(source, base, list(by), probs, weight, finite_only, bracket_rows, slices, accuracy, coefs)
        both = both.join(positions.withColumnRenamed("__group", "__of"), F.col("__group") == F.col("__of"), "left")
        named |= {quoted(name): _interpolated(i, k, p, weight) for i in probs for k, p in enumerate(_distinct(probs[i])) for name, q in probs[i].items() if q == p}
        if coefs:
            quartiles = {i: [_interpolated(i, _distinct(probs[i]).index(p), p, None) for p in (0.25, 0.75)] for i in coefs}
            hinges = [f"named_struct('col', {i}, 'low', {low}, 'high', {high}, 'reach', {coefs[i]!r}D * ({high} - {low}))" for i, (low, high) in quartiles.items()]
            limits = both.selectExpr("__group", *by, f"inline(array({', '.join(hinges)}))")
            limits = store(limits.selectExpr("__group", *by, "col", "low - reach AS least", "high + reach AS most"))
            ends = _whiskers(source, cells, limits, list(by), len(cols), list(coefs))
            both = both.join(ends, F.col("__group") == F.col("__ends"), "left")
            named |= {quoted(f"{name}_{cols[i]}"): f"{name}_{i}" for i in coefs for name in WHISKERS}
    return both.selectExpr(*names, *[f"{named[c]} AS {c}" if c in named else c for c in order])


WHISKERS = ("lower_whisker", "upper_whisker", "n_outliers")


def _whiskers(source, cells, limits, by, m, used) -> DataFrame:
    """Per group number the whiskers and outliers of each column, from the counted cells and the limits of each group."""
    known = limits.selectExpr(f"__group * {m} + col AS of", "least", "most", "__group AS __ends", "col", *by)
    placed = cells.join(known, F.col("bracket") == F.col("of"))
    cut = "(lo < least AND hi >= least OR lo <= most AND hi > most)"
    inside = "BETWEEN least AND most"
    parts = placed.where(f"NOT {cut}").selectExpr(
        "__ends", "col", f"CASE WHEN lo {inside} THEN lo END AS low", f"CASE WHEN hi {inside} THEN hi END AS high", f"CASE WHEN lo {inside} THEN 0 ELSE rows END AS out"
    )
    torn = placed.where(cut).select("__ends", "col", "least", "most", "lo", "hi", *by)
    if not torn.isEmpty():
        parts = parts.unionByName(_reread(source, torn, by, used))
    at = [
        expr
        for i in used
        for expr in (
            f"min(CASE WHEN col = {i} THEN low END) AS lower_whisker_{i}", f"max(CASE WHEN col = {i} THEN high END) AS upper_whisker_{i}",
            f"sum(CASE WHEN col = {i} THEN out END) AS n_outliers_{i}",
        )
    ]
    return parts.groupBy("__ends").agg(*map(F.expr, at))


def _reread(source, torn, by, used) -> DataFrame:
    """The same parts from the rows of the ranges that a fence cuts."""
    items = ", ".join(f"named_struct('c', {i}, 'x', __v{i})" for i in used)
    values = source.selectExpr(*by, f"inline(array({items}))").where("x IS NOT NULL")
    conds = [values[k].eqNullSafe(torn[k]) for k in by] + [values["c"] == torn["col"], values["x"].between(torn["lo"], torn["hi"])]
    inside = "x BETWEEN least AND most"
    return values.join(torn, reduce(and_, conds)).groupBy("__ends", "col").agg(
        F.expr(f"min(CASE WHEN {inside} THEN x END) AS low"), F.expr(f"max(CASE WHEN {inside} THEN x END) AS high"),
        F.expr(f"count(CASE WHEN NOT ({inside}) THEN 1 END) AS out"),
    )


def _moment(stat: str, i: int, weight: str | None) -> str:
    if weight and stat in ("mean", "sum"):
        total = f"sum(__w * __v{i})"
        return total if stat == "sum" else f"try_divide({total}, sum(CASE WHEN __v{i} IS NOT NULL THEN __w END))"
    return "NULL" if weight and stat in ("sd", "var") else f"{MOMENTS[stat]}(__v{i})"


def _with_squares(source: DataFrame, base: DataFrame, by: list[str], used: list[int]):
    """Weighted squares about the groups' weighted means, by a scan of their own: they would cancel if taken with the means."""
    mids = [f"mid_{i}" for i in used]
    if by:
        rows = join_groups(source, base.select("__group", *by, *mids), by)
    else:
        only = base.first()
        rows = source.select("*", *[F.lit(only[c]).cast("double" if c in mids else "long").alias(c) for c in ("__group", *mids)])
    squares = rows.groupBy(F.col("__group").alias("__in")).agg(*[F.expr(f"try_divide(sum(__w * pow(__v{i} - mid_{i}, 2)), sum(CASE WHEN __v{i} IS NOT NULL THEN __w END)) AS square_{i}") for i in used])

    def named(stat: str, i: int) -> str:
        var = f"CASE WHEN count_{i} > 1 THEN square_{i} * count_{i} / (count_{i} - 1) END"
        return var if stat == "var" else f"sqrt({var})"

    return base.join(squares, F.col("__group") == F.col("__in"), "left"), named


def _over_implicates(each: DataFrame, by: Sequence[str], measures, count: str | None, implicate: str) -> DataFrame:
    """One row per group from one row per group and implicate; `each` is small and stored."""
    m = each.select(implicate).distinct().count()
    whole = {stat_name(s, c) for c in measures for s in measures[c] if s in ("sum", "n")} | ({count} if count else set())
    names = [stat_name(s, c) for c in measures for s in measures[c]] + ([count] if count else [])
    mean = [(F.sum(quoted(c)) / F.lit(m) if c in whole else F.avg(quoted(c))).alias(c) for c in names]
    return each.groupBy(*map(quoted, by)).agg(*mean)


def stat_name(stat: str | float, col: str) -> str:
    if isinstance(stat, str):
        return f"{stat}_{col}"
    return f"p{round(stat * 100, 6):g}_{col}".replace(".", "_")


def _probability(stat: str | float) -> float:
    if stat == "median":
        return 0.5
    if isinstance(stat, str) or not 0 <= stat <= 1:
        raise ValueError(f"unknown statistic {stat!r}")
    return float(stat)


def _distinct(probs: Mapping[str, float]) -> list[float]:
    return sorted(set(probs.values()))


def _interpolated(i: int, k: int, p: float, weight: str | None) -> str:
    """Value at position (n - 1) p between the two neighbouring order statistics; with weights the one that was found."""
    low, high = f"try_element_at(at_{i}, {2 * k})", f"try_element_at(at_{i}, {2 * k + 1})"
    if weight:
        return low
    h = f"((n_{i} - 1) * double('{p!r}'))"
    return f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({h} - floor({h})) * ({high} - {low}) END"


def _wanted(i: int, probs: Mapping[str, float], weight: str | None) -> str:
    """The wanted places of a column, counted from 1: (k, t) with k as `_interpolated` asks for it."""
    out = []
    for k, p in enumerate(_distinct(probs)):
        if weight:
            out.append(f"named_struct('k', {2 * k}, 't', w_{i} * double('{max(p - REACHED, 0.0)!r}'))")
        else:
            h = f"((n_{i} - 1) * double('{p!r}'))"
            out += [f"named_struct('k', {2 * k + up}, 't', double({f}({h})) + 1D)" for up, f in enumerate(("floor", "ceil"))]
    return f"array({', '.join(out)})"


def _order_statistics(source, base, by, probs, weight, finite_only, bracket_rows, slices, accuracy, coefs) -> tuple[DataFrame, DataFrame | None]:
    """Per group number, one map of the wanted values for each column with quantiles: `at_0`, `at_1`, ...; and the counted cells."""
    used = [i for i in probs if probs[i]]
    real = ("lo", "hi") if finite_only else ("flo", "fhi")
    pieces = [
        f"named_struct('bracket', __group * {len(probs)} + {i}, 'col', {i}, 'lo', lo_{i}, 'hi', hi_{i}, 'flo', {real[0]}_{i}, "
        f"'fhi', {real[1]}_{i}, 'below', 0D, 'rows', n_{i}, 'wanted', {_wanted(i, probs[i], weight)})"
        for i in used
    ]
    whole = base.selectExpr("__group", *by, f"inline(array({', '.join(pieces)}))").where("rows > 0")
    items = ", ".join(f"named_struct('col', {i}, 'x', __v{i})" for i in used)
    values = source.selectExpr(*by, *(["__w"] if weight else []), f"inline(array({items}))").where("x IS NOT NULL")

    brackets, cells = whole, None
    if not weight:
        cells = _sketched(source, base, by, probs, real, bracket_rows, slices, accuracy, coefs)
        cells = store(cells) if coefs else cells
        brackets = store(_holding(cells, whole, by))
    done: list[DataFrame] = []
    while not (open_ := brackets.where("lo < hi")).isEmpty():
        done.append(brackets.where("lo = hi"))
        brackets = store(_holding(_cells(values, open_, by, weight, bracket_rows, slices), open_, by))
    found = reduce(DataFrame.unionByName, [*done, brackets]).selectExpr("__group", "col", "lo AS x", "inline(wanted)")
    maps = [
        f"map_from_entries(collect_list(CASE WHEN col = {i} THEN named_struct('k', k, 'x', x) END)) AS at_{i}"
        for i in used
    ]
    return found.groupBy("__group").agg(*map(F.expr, maps)), cells


def _margins(accuracy: int) -> list[float]:
    return [2 / accuracy, *[m for m in MARGINS if m > 2 / accuracy]]


def _near(probs, accuracy: int) -> list[float]:
    """What the sketch is asked for: places on both sides of each wanted one."""
    return sorted({min(1.0, max(0.0, p + sign * m)) for p in probs for m in _margins(accuracy) for sign in (-1, 1)})


def _sketched(source, base, by, probs, real, bracket_rows, slices, accuracy, coefs) -> DataFrame:
    """Counts of the first search: of rows between the ranges that the sketch names, and inside them of values (or slices)."""
    used = [i for i in probs if probs[i]]
    # A margin does for a group in which it is wider than the error of the sketch and two ranks more.
    enough = [(m, 2 / (m - 1 / accuracy)) for m in _margins(accuracy)]

    def chosen(i: int, of, rest: str) -> str:
        return "CASE " + " ".join(f"WHEN n_{i} >= {n!r}D THEN {of(m)}" for m, n in enough) + f" ELSE {rest} END"

    def bound(i: int, p: float, sign: int) -> str:
        near = _near(probs[i].values(), accuracy)
        end = f"hi_{i}" if sign > 0 else f"lo_{i}"
        return chosen(i, lambda m: end if not 0 < p + sign * m < 1 else f"sketch_{i}[{near.index(p + sign * m)}]", end)

    ranges, segments, items = ["__group"], [], []
    for i in used:
        ps = _distinct(probs[i])
        many = chosen(i, lambda m: f"n_{i} * {2 * m!r}D > {bracket_rows}", f"n_{i} > {bracket_rows}")
        ends = [(bound(i, p, -1), bound(i, p, 1)) for p in ps]
        if i in coefs:
            # A fence is where it would be for some quartiles in their ranges, and not between the quartiles.
            c, (a, b), (d, e) = f"{coefs[i]!r}D", ends[ps.index(0.25)], ends[ps.index(0.75)]
            low = (f"{a} - {c} * ({e} - {a})", f"least({ends[0][1]}, {b}, {b} - {c} * ({d} - {b}))")
            high = (f"greatest({ends[-1][0]}, {d}, {d} + {c} * ({d} - {b}))", f"{e} + {c} * ({e} - {a})")
            ends = [low, *ends, high]
        places = range(len(ends))
        ranges += [f"{x} AS {end}_{i}_{j}" for j, pair in enumerate(ends) for x, end in zip(pair, ("from", "to"))]
        ranges += [f"{many} AS many_{i}", f"{real[0]}_{i} AS real_lo_{i}", f"{real[1]}_{i} AS real_hi_{i}"]
        inside = " ".join(f"WHEN __v{i} <= to_{i}_{j} THEN CASE WHEN __v{i} >= from_{i}_{j} THEN {2 * j + 1} ELSE {2 * j} END" for j in places)
        segments.append(f"CASE {inside} ELSE {2 * len(places)} END AS seg_{i}")
        ends = [" ".join(f"WHEN {2 * j + 1} THEN {f}({end}_{i}_{j}, real_{r}_{i})" for j in places) for f, end, r in (("greatest", "from", "lo"), ("least", "to", "hi"))]
        flo, fhi = (f"CASE WHEN many_{i} THEN CASE seg_{i} {e} END END" for e in ends)
        items.append(f"named_struct('col', {i}, 'x', __v{i}, 'seg', seg_{i}, 'flo', {flo}, 'fhi', {fhi})")
    groups = base.selectExpr(*by, *ranges)
    if by:
        rows = join_groups(source, groups, by)
    else:
        only = groups.first()
        rows = source.select("*", *[F.lit(only[f.name]).cast(f.dataType).alias(f.name) for f in groups.schema])
    rows = rows.selectExpr("*", *segments).selectExpr("__group", f"inline(array({', '.join(items)}))").where("x IS NOT NULL")
    inside = "seg % 2 = 1"
    counted = rows.selectExpr(
        f"__group * {len(probs)} + col AS bracket", "x", "seg", "1D AS mass",
        f"CASE WHEN {inside} AND flo IS NULL THEN x END AS at_x", f"CASE WHEN {inside} AND flo IS NOT NULL THEN {_slice(slices)} END AS slice",
    )
    return _counted(counted, "seg")


def _counted(rows: DataFrame, *more: str) -> DataFrame:
    real = f"CASE WHEN abs(x) < {INF} THEN x END"
    return rows.groupBy("bracket", *more, "at_x", "slice").agg(
        F.expr("sum(mass) AS mass"), F.expr("count(1) AS rows"), F.expr("min(x) AS lo"), F.expr("max(x) AS hi"),
        F.expr(f"min({real}) AS flo"), F.expr(f"max({real}) AS fhi"),
    )


def _cells(values: DataFrame, brackets: DataFrame, by: list[str], weight: str | None, bracket_rows: int, slices: int) -> DataFrame:
    """Counts inside brackets: of values where few rows lie in one, else of slices. Only rows inside a bracket pass the join."""
    conds = [values[k].eqNullSafe(brackets[k]) for k in by]
    conds += [values["col"] == brackets["col"], values["x"].between(brackets["lo"], brackets["hi"])]
    inside = values.join(brackets, reduce(and_, conds))
    few = f"rows <= {bracket_rows}"
    return _counted(
        inside.selectExpr(
            "bracket", "x", f"{'__w' if weight else '1D'} AS mass",
            f"CASE WHEN {few} THEN x END AS at_x", f"CASE WHEN NOT ({few}) THEN {_slice(slices)} END AS slice",
        )
    )


def _holding(cells: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """The cells that hold a wanted place, as the next brackets. Cells are disjoint, so their order is that of their values.

    A place beyond all cells belongs to the last one: sums of weights in another order may fall short in the last bit.
    """
    order = Window.partitionBy("bracket").orderBy("lo")
    summed = cells.withColumn("upto", F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.select("*", F.lag("upto").over(order).alias("before"), F.lead("upto").over(order).isNull().alias("last"))
    known = brackets.select(F.col("bracket").alias("of"), "__group", *by, "col", "below", "wanted")
    mine = "filter(wanted, r -> (before IS NULL OR r.t > below + before) AND (last OR r.t <= below + upto))"
    return (
        summed.join(known, F.col("bracket") == F.col("of"))
        .selectExpr(
            "__group", *by, "col", "lo", "hi", "flo", "fhi", "below + coalesce(before, 0D) AS below", "rows", f"{mine} AS wanted"
        )
        .where("size(wanted) > 0")
        .selectExpr("*", "monotonically_increasing_id() AS bracket")
    )


def _slice(slices: int) -> str:
    """Slice number of x within its bracket; infinities get slices of their own.

    The signed logarithm, shifted so that it grows with x and is 0 at 0, slices brackets of more than one unit of it.
    """

    def scaled(c: str) -> str:
        return f"coalesce(signum({c}) * (ln(abs({c})) + 746D), 0D)"

    def part(x: str, lo: str, hi: str) -> str:
        return f"floor(coalesce(try_divide({x} - {lo}, {hi} - {lo}), 0) * {slices})"

    wide = f"{scaled('fhi')} - {scaled('flo')} > 1"
    number = f"CASE WHEN {wide} THEN {part(scaled('x'), scaled('flo'), scaled('fhi'))} ELSE {part('x', 'flo', 'fhi')} END"
    return f"CASE WHEN x = {INF} THEN {slices}L WHEN x = -{INF} THEN -1L ELSE least({slices - 1}L, {number}) END"


def quantile_values(df: DataFrame, probs: Mapping[str, Sequence[float]], **options) -> dict[tuple[str, float], float]:
    """Pooled quantiles of columns as plain numbers: one result row comes to the driver.

    Used as literals they reach the scan as pushed-down filters.
    """
    row = describe_by(df, [], probs, **options).first()
    return {(c, p): row[stat_name(p, c)] for c, ps in probs.items() for p in ps}
