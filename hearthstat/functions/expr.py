"""Column expressions with explicit missing-value rules.

Every function takes and returns Spark columns, so the work stays in generated code. NULL stands for
a missing value; NaN is never produced.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

INF = float("inf")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name for use inside SQL text."""
    return "`" + name.replace("`", "``") + "`"


def finite_sql(name: str) -> str:
    """SQL text of `finite` for a named column."""
    x = f"double({quoted(name)})"
    return f"CASE WHEN abs({x}) < double('infinity') THEN {x} END"


def valid_sql(name: str) -> str:
    """SQL text: the value as a double, NULL for NaN."""
    x = f"double({quoted(name)})"
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den; n/0 is an infinity with the sign of n, 0/0 and missing inputs are NULL."""
    n, d = column(num).cast("double"), column(den).cast("double")
    at_zero = F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF))
    return F.when(d == 0, at_zero).otherwise(F.try_divide(n, d))


def finite(c: Column | str) -> Column:
    """The value, or NULL where it is infinite or NaN."""
    x = column(c).cast("double")
    return F.when(F.abs(x) < F.lit(INF), x)


def log_plus_one(c: Column | str) -> Column:
    """ln(x + 1): -Infinity at x = -1, NULL below."""
    x = column(c).cast("double")
    return F.when(x == -1, F.lit(-INF)).when(x > -1, F.log1p(x))


def row_sum(cols: Iterable[Column | str]) -> Column:
    """Sum across columns, missing parts skipped; a row with no value at all gives 0."""
    return reduce(add, [F.coalesce(column(c).cast("double"), F.lit(0.0)) for c in cols])


def flag(cond: Column) -> Column:
    """1 / 0, and NULL where the condition is unknown."""
    return F.when(cond, 1).when(~cond, 0)


def flag_or_zero(cond: Column) -> Column:
    """1 / 0, and 0 where the condition is unknown."""
    return F.when(cond, 1).otherwise(0)


def is_in(c: Column | str, values: Sequence) -> Column:
    """Membership that is never unknown: a missing value is not a member."""
    return F.coalesce(column(c).isin(*values), F.lit(False))


def cut(
    c: Column | str,
    breaks: Sequence[float],
    labels: Sequence | None = None,
    include_lowest: bool = True,
) -> Column:
    """Label of the interval (a, b] that holds the value; NULL outside all of them.

    With `include_lowest` the first interval also holds its lower end. Without labels the result is
    the 1-based interval number.
    """
    if sorted(set(breaks)) != list(breaks):
        raise ValueError(f"breaks must be strictly increasing: {list(breaks)}")
    if labels is None:
        labels = list(range(1, len(breaks)))
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per interval is needed")
    x = column(c)
    first = float(breaks[0])
    out = F.when((x < first) if include_lowest else (x <= first), None)
    for upper, label in zip(breaks[1:], labels):
        out = out.when(x <= float(upper), label)
    return out


def closed_bands(c: Column | str, bands: Sequence[tuple[float, float, int]], default: int = 0) -> Column:
    """Code of the closed interval [a, b] that holds the value, else the default."""
    x = column(c)
    out = None
    for low, high, code in bands:
        hit = x.between(low, high)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(default)


def half_open_bands(c: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Label by the cut points passed: below cuts[0], [cuts[0], cuts[1]), ..., from the last cut up."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("there is one label more than there are cut points")
    x = column(c)
    out = F.when(x.isNull(), None)
    for upper, label in zip(cuts, labels):
        out = out.when(x < upper, label)
    return out.otherwise(labels[-1])


def level_index(c: Column | str, levels: Sequence) -> Column:
    """1-based position in the level list; NULL for values outside it. Use as a sort key."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), column(c)), F.lit(0))


def as_level(c: Column | str, levels: Sequence) -> Column:
    """The value if it is one of the levels, else NULL."""
    x = column(c)
    return F.when(x.isin(*levels), x)


def lookup(c: Column | str, names: Mapping) -> Column:
    """Value of the code in a fixed map, NULL for an unknown code."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), column(c))


def recode(c: Column | str, names: Mapping) -> Column:
    """Like `lookup`, but an unknown code stays as it is."""
    return F.coalesce(lookup(c, names), column(c))


def first_match(c: Column | str, rules: Sequence[tuple[str, object]], default=None) -> Column:
    """Result of the first regular expression found in the string, else the default."""
    x = column(c)
    out = None
    for pattern, result in rules:
        hit = x.rlike(pattern)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(default)


def interaction(*cols: Column | str, sep: str = ".") -> Column:
    """Joint label of several factors; one factor is itself, a missing part makes it NULL."""
    parts = [column(c) for c in cols]
    if len(parts) == 1:
        return parts[0]
    complete = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(complete, F.concat_ws(sep, *parts))


def format_percent(c: Column | str, digits: int = 0) -> Column:
    return F.concat(F.format_number(column(c) * 100, digits), F.lit("%"))


def format_comma(c: Column | str, digits: int = 0) -> Column:
    return F.format_number(column(c), digits)


def format_thousands(c: Column | str, digits: int = 0) -> Column:
    return F.concat(F.format_number(column(c) / 1000, digits), F.lit("K"))
