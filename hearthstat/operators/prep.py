"""Stacking, joining, recoding and trimming of survey tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expr import cut
from hearthstat.operators.quantiles import quantile_values


# ---- names and columns -------------------------------------------------------------------------


def upper_names(df: DataFrame) -> DataFrame:
    """All column names in upper case; input files mix cases."""
    names = [c.upper() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names differ only in case: {df.columns}")
    return df.toDF(*names)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by name; a name that is absent is skipped."""
    return df.withColumnsRenamed(dict(names))


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from `first` to `last` in table order."""
    i, j = df.columns.index(first), df.columns.index(last)
    if i > j:
        raise ValueError(f"{first} stands after {last}")
    return df.columns[i : j + 1]


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def fill_missing(df: DataFrame, value: float = 0, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become `value`, in the whole table or in the given columns."""
    return df.na.fill(value, subset=list(cols) if cols else None)


# ---- stacking ------------------------------------------------------------------------------------


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same column names, matched by name in any order."""
    for part in parts[1:]:
        if set(part.columns) != set(parts[0].columns):
            raise ValueError(f"columns differ: {sorted(set(part.columns) ^ set(parts[0].columns))}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def tag_subsets(df: DataFrame, subsets: Sequence[tuple[Column, str]], name: str = "group") -> DataFrame:
    """Stack of labelled, disjoint subsets in one pass; rows in none of them are left out."""
    label = None
    for cond, text in subsets:
        label = F.when(cond, text) if label is None else label.when(cond, text)
    return df.withColumn(name, label).where(F.col(name).isNotNull())


def to_long(df: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per listed column: its name and its value; the other columns are repeated."""
    ids = [c for c in df.columns if c not in set(cols)]
    return df.unpivot(ids, list(cols), name, value)


# ---- joins ---------------------------------------------------------------------------------------


def left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str] | Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    missing_matches: bool = True,
    compare_only: Sequence[str] = (),
) -> DataFrame:
    """Left equi-join keeping the left keys; several matches give several rows.

    A missing key matches a missing key unless `missing_matches` is off. Other columns present on
    both sides get the suffixes. Keys in `compare_only` are checked on the matches of the other keys
    and do not steer the shuffle: joins of several tables on the same other keys then share one.
    """
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    shared = (set(left.columns) - set(pairs)) & (set(right.columns) - set(pairs.values()))
    left_names = {c: c + suffixes[0] for c in shared}
    right_names = {c: c + suffixes[1] for c in shared}
    key_names = {r: f"__key_{i}" for i, r in enumerate(pairs.values())}
    a = left.withColumnsRenamed(left_names)
    b = right.withColumnsRenamed({**right_names, **key_names})
    conds = []
    for l, r in pairs.items():
        x, y = a[l], b[key_names[r]]
        if l in compare_only:
            # Equality as two bounds: the planner takes it as a condition, not as a shuffle key.
            equal = (x >= y) & (x <= y)
            conds.append(F.coalesce(equal, x.isNull() & y.isNull()) if missing_matches else equal)
        else:
            conds.append(x.eqNullSafe(y) if missing_matches else x == y)
    return a.join(b, reduce(and_, conds), "left").drop(*key_names.values())


HOUSEHOLD_KEYS = ["ID", "SURVEY", "SA0010", "SA0100", "IM0100"]


def merge_households(derived: DataFrame, core: DataFrame) -> DataFrame:
    """Join the two household tables on household, implicate and weight.

    The weight is compared only, so that the reference persons can be attached without another shuffle.
    """
    return left_join(derived, core, [*HOUSEHOLD_KEYS, "HW0010"], compare_only=["HW0010"])


def attach_reference(households: DataFrame, persons: DataFrame) -> DataFrame:
    """Attach to each household and implicate its reference person (RA0100 = 1).

    The person's own identifier becomes PERSON_ID. A household with two reference persons appears
    twice, one without any keeps NULLs.
    """
    reference = persons.where(F.col("RA0100") == 1).withColumnRenamed("ID", "PERSON_ID")
    keys = {k: "HID" if k == "ID" else k for k in HOUSEHOLD_KEYS}
    return left_join(households, reference, keys)


# ---- trimming and quantile classes -----------------------------------------------------------------


def trim_quantiles(
    df: DataFrame, upper: Mapping[str, float] | None = None, lower: Mapping[str, float] | None = None, **options
) -> DataFrame:
    """Keep the rows between the pooled quantiles of each column, ends included.

    All thresholds come from the untrimmed table. A missing value fails its condition. The input is
    read once for the thresholds and once more for the rows: store a costly input first and say
    `stored=True`.
    """
    upper, lower = dict(upper or {}), dict(lower or {})
    probs: dict[str, list[float]] = {}
    for col, p in [*upper.items(), *lower.items()]:
        probs.setdefault(col, []).append(p)
    limits = quantile_values(df, probs, **options)
    conds = [F.col(c) <= F.lit(limits[c, p]) for c, p in upper.items()]
    conds += [F.col(c) >= F.lit(limits[c, p]) for c, p in lower.items()]
    return df.where(reduce(and_, conds))


def quantile_class(df: DataFrame, col: str, labels: Sequence[str], name: str, **options) -> DataFrame:
    """Label rows by equal-share quantile classes (a, b]; equal values share a class.

    Raises if two class limits coincide.
    """
    k = len(labels)
    probs = [i / k for i in range(k + 1)]
    limits = quantile_values(df, {col: probs}, **options)
    breaks = [limits[col, p] for p in probs]
    if any(b is None for b in breaks) or len(set(breaks)) != len(breaks):
        raise ValueError(f"quantile limits of {col} are not distinct: {breaks}")
    return df.withColumn(name, cut(col, breaks, labels))
