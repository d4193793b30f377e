"""Correlation panels, least squares and instrumental variables from distributed moments.

The data are scanned once per call: for moments, or for the triangular factors of the tasks' rows where there are several
regressors. Estimates and tests are arithmetic on these. Every result covers each group and, as scope ALL, all groups together.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expr import finite, finite_sql, valid_sql
from hearthstat.functions.tails import NORMAL_975, f_upper, t_critical_95, t_pvalue, t_two_sided
from hearthstat.operators.moments import POOLED, pair_moments, scope_name, with_pooled
from hearthstat.operators.quantiles import describe_by, join_groups
from hearthstat.sources.stored import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _correlation() -> Column:
    """sxy / sqrt(sxx syy), within [-1, 1]; NULL for a constant variable."""
    varies = (F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y"))
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    # greatest and least pass over NULL, so they stay inside the condition.
    return F.when(varies & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def corr_panel(
    df: DataFrame,
    by: str,
    pairs: Mapping[str, tuple[str, str]],
    strict: Sequence[str] = (),
    finite_only: bool = True,
) -> DataFrame:
    """Pearson correlation of each pair per group and pooled.

    A pair named in `strict` has a NULL pooled result if any row misses x or y; the others use the
    rows where both are present.
    """
    m = with_pooled(pair_moments(df, by, pairs, finite_only), by)
    r = _correlation()
    if strict:
        lost = F.col("pair").isin(*strict) & (F.col("scope") == POOLED) & (F.col("n_dropped") > 0)
        r = F.when(~lost, r)
    return m.select("scope", "pair", "n", "n_dropped", r.alias("r"))


def corr_test(df: DataFrame, by: str, pairs: Mapping[str, tuple[str, str]], finite_only: bool = True) -> DataFrame:
    """Test of zero correlation per pair and scope: r, t, df, two-sided p, 95 % interval (Fisher z)."""
    return corr_inference(with_pooled(pair_moments(df, by, pairs, finite_only), by).withColumn("r", _correlation()))


def corr_inference(table: DataFrame) -> DataFrame:
    """t, df, p and interval for rows with `r` and `n`; needs n > 2, the interval n > 3."""
    r, n = F.col("r"), F.col("n")
    dof = F.when(n > 2, (n - 2).cast("double"))
    at_one = F.when(r > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    t = F.when(F.abs(r) == 1, at_one).otherwise(r * F.sqrt(F.try_divide(dof, 1 - r * r)))
    half = F.try_divide(F.lit(NORMAL_975), F.sqrt(F.when(n > 3, (n - 3).cast("double"))))
    keep = [c for c in ("scope", "pair") if c in table.columns]
    return table.select(
        *keep,
        "n",
        "r",
        dof.alias("df"),
        F.when(dof.isNotNull(), t).alias("t"),
        F.tanh(F.atanh(r) - half).alias("ci_low"),
        F.tanh(F.atanh(r) + half).alias("ci_high"),
    ).withColumn("p", t_pvalue("t", "df"))


def ols_simple(df: DataFrame, by: str, models: Mapping[str, tuple[str, str]], finite_only: bool = True) -> DataFrame:
    """Fits of y on one regressor, given as name -> (x, y), per group and pooled, all from one scan."""
    m = with_pooled(pair_moments(df, by, models, finite_only), by)
    return simple_fit(m).withColumnRenamed("pair", "model")


def simple_fit(m: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Intercept, slope, standard errors and fit of y on x from moment rows.

    Where x is constant the slope is NULL and the fit is that of the constant alone.
    """
    varies = F.coalesce(F.col("min_x") < F.col("max_x"), F.lit(False))
    sxx = F.when(F.col("min_x") < F.col("max_x"), F.nullif(F.col("sxx"), F.lit(0.0)))
    params = F.when(varies, 2).otherwise(1)
    dof = F.when(F.col("n") > params, (F.col("n") - params).cast("double"))
    return (
        m.withColumn("slope", F.try_divide(F.col("sxy"), sxx))
        .withColumn("intercept", F.col("mean_y") - F.coalesce(F.col("slope") * F.col("mean_x"), F.lit(0.0)))
        .withColumn("df", dof)
        .withColumn("rss", F.expr("greatest(0D, syy - coalesce(slope * sxy, 0D))"))
        .withColumn("sigma", F.sqrt(F.try_divide(F.col("rss"), F.col("df"))))
        .withColumn("se_slope", F.try_divide(F.col("sigma"), F.sqrt(sxx)))
        .withColumn(
            "se_intercept",
            F.col("sigma") * F.sqrt(
                F.try_divide(F.lit(1.0), F.col("n"))
                + F.when(varies, F.try_divide(F.pow("mean_x", F.lit(2)), sxx)).otherwise(0.0)
            ),
        )
        .withColumn("t_slope", F.try_divide(F.col("slope"), F.col("se_slope")))
        .withColumn("t_intercept", F.try_divide(F.col("intercept"), F.col("se_intercept")))
        .withColumn("r2", 1 - F.try_divide(F.col("rss"), F.col("syy")))
        .select(
            "scope", "pair", "n", "df", "intercept", "slope", "se_intercept", "se_slope",
            "t_intercept", "t_slope", "sigma", "r2", *keep,
        )
        .withColumn("p_slope", t_pvalue("t_slope", "df"))
    )


def lm_band(
    df: DataFrame, by: str, models: Mapping[str, tuple[str, str]], points: int = 80, finite_only: bool = True
) -> DataFrame:
    """Fitted line with its 95 % confidence band on an even grid over the range of x."""
    m = with_pooled(pair_moments(df, by, models, finite_only), by)
    fits = simple_fit(m, ["mean_x", "sxx", "min_x", "max_x"]).withColumn("t", t_critical_95("df"))
    step = (F.col("max_x") - F.col("min_x")) / F.lit(points - 1)
    grid = fits.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("min_x") + F.col("point") * step)
    grid = grid.withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    spread = F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.pow(F.col("x") - F.col("mean_x"), 2), F.col("sxx"))
    half = F.col("t") * F.col("sigma") * F.sqrt(spread)
    return grid.select(
        "scope", F.col("pair").alias("model"), "point", "x", "fit", (F.col("fit") - half).alias("low"),
        (F.col("fit") + half).alias("high"),
    )


# ---- several regressors, instruments -----------------------------------------------------------------

_FIT_SCHEMA = (
    "scope string, term string, estimate double, std_error double, t double, p double, n long, df long, "
    "sigma double, r2 double, adj_r2 double, f double, f_p double"
)


ALIASED = 1e-7  # part of its length that a regressor keeps besides those before it, from which it is in the fit
IDENTIFIED = 1e-12  # part of its length that the instruments must give of a regressor
CHUNK = 8192  # rows that are reduced to a triangle at once
OPEN_GROUPS = 4096  # groups of which a task holds a triangle


def _triangles(cols: int):
    """Reduce the rows (scope, values) of a task to one triangular factor per group, and one of all rows.

    The factor R of a table A = QR has the same lengths and angles between columns as A, without squaring anything.
    Factors of parts, put under each other, have the factor of the whole.
    """

    def reduced(parts: list[np.ndarray]) -> np.ndarray:
        # Padded, so that even an empty part gives a square factor.
        return np.linalg.qr(np.vstack([*parts, np.zeros((cols, cols))]), mode="r")

    def run(batches):
        held: dict[str | None, list] = {}  # scope -> rows, factor

        def flushed():
            rows = [(scope, n, r) for scope, (n, r) in held.items() if scope is not None]
            if held:
                rows.append((POOLED, sum(n for n, _ in held.values()), reduced([r for _, r in held.values()])))
            held.clear()
            scopes, counts, factors = zip(*rows) if rows else ([], [], [])
            flat = [r.ravel().tolist() for r in factors]
            return pa.RecordBatch.from_arrays(
                [pa.array(scopes, pa.string()), pa.array(counts, pa.int64()), pa.array(flat, pa.list_(pa.float64()))],
                names=["scope", "n", "factor"],
            )

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy()
            table = np.column_stack([np.ones(len(batch)), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            whole = ~np.isnan(table).any(axis=1)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order], prepend=-2)) if len(order) else []
            for first, last in zip(cuts, [*cuts[1:], len(order)]):
                mine = order[first:last]
                code, mine = codes[mine[0]], mine[whole[mine]]
                entry = held.setdefault(names[code] if code >= 0 else None, [0, np.zeros((cols, cols))])
                entry[0] += len(mine)
                for at in range(0, len(mine), CHUNK):
                    entry[1] = reduced([entry[1], table[mine[at : at + CHUNK]]])
                if len(held) >= OPEN_GROUPS:
                    yield flushed()
        yield flushed()

    return run


def _solver(n_x: int, n_z: int, terms: Sequence[str], instruments: bool):
    """Fit one scope from the triangular factors of its parts: the columns are the constant, y, x..., z..."""
    size = 2 + n_x + n_z
    xs = list(range(2, 2 + n_x))
    zs = list(range(2 + n_x, size)) if instruments else xs

    def basis(r, of, least=ALIASED, lengths=None):
        """Of these columns, in order, those with a length of their own, and unit vectors that span them."""
        lengths = np.linalg.norm(r, axis=0) if lengths is None else lengths
        kept, q = [], np.zeros((len(r), 0))
        for j in of:
            rest = r[:, j]
            for _ in range(2):  # once more, against rounding
                rest = rest - q @ (q.T @ rest)
            length = np.linalg.norm(rest)
            if length > least * lengths[j]:
                kept.append(j)
                q = np.column_stack([q, rest / length])
        return kept, q

    def solve_one(scope, n, r):
        zcols, qz = basis(r, [0, *zs])
        fitted = r.copy()
        if instruments:  # regressors as far as the instruments give them
            fitted[:, xs] = qz @ (qz.T @ r[:, xs])
        # What is left out for want of a length of its own is left out of the data, not of their projection.
        wanted, span = basis(r, [0, *xs])
        kept, q = basis(fitted, wanted, IDENTIFIED, np.linalg.norm(r, axis=0)) if instruments else (wanted, span)
        dof = n - len(wanted)
        none = [(scope, t, *[None] * 4, n, dof, *[None] * 5) for t in ["(Intercept)", *terms]]
        if n == 0 or dof <= 0 or kept != wanted:
            return none
        y = r[:, 1]
        beta = np.linalg.solve(q.T @ fitted[:, kept], q.T @ y)
        # Zeros below the diagonal up to rounding: the inverse of the factor gives that of the cross products.
        inverse = np.linalg.inv(np.triu(q.T @ fitted[:, kept]))
        cov = inverse @ inverse.T
        rss = float(np.sum((y - r[:, kept] @ beta) ** 2))
        unit = r[:, 0] / np.linalg.norm(r[:, 0])
        tss = float(np.sum((y - unit * (unit @ y)) ** 2))
        rank = len(kept) - 1
        s2 = rss / dof
        se = np.sqrt(s2 * np.diag(cov))
        r2 = 1 - rss / tss if tss > 0 else np.nan
        # Joint test of all slopes, with the same covariance as the single tests.
        f = float(beta[1:] @ np.linalg.solve(cov[1:, 1:], beta[1:]) / rank / s2) if s2 > 0 and rank else np.nan
        fit = (n, dof, np.sqrt(s2), r2, 1 - (1 - r2) * (n - 1) / dof, f, f_upper(f, rank, dof))
        found = dict(zip(kept, zip(beta, se)))
        rows = []
        for j, term in zip([0, *xs], ["(Intercept)", *terms]):
            b, e = found.get(j, (None, None))
            t = b / e if e is not None and e > 0 else np.nan
            rows.append((scope, term, b, e, t, t_two_sided(t, dof), *fit))
        return rows

    def solve(pdf):
        parts = [np.reshape(f, (size, size)) for f in pdf["factor"]]
        while len(parts) > 1:
            parts = [np.linalg.qr(np.vstack(parts[i : i + 256]), mode="r") for i in range(0, len(parts), 256)]
        rows = solve_one(pdf["scope"].iloc[0], int(pdf["n"].sum()), parts[0])
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _FIT_SCHEMA.split(", ")])

    return solve


def _fit(df, by, y, xs, zs, finite_only) -> DataFrame:
    """Merged triangular factors: a scope's merge reads one small factor from each task, never rows."""
    cols = [y, *xs, *(zs or [])]
    valid = finite_sql if finite_only else valid_sql
    rows = df.selectExpr(f"{scope_name(by)} AS scope", *[f"{valid(c)} AS v{i}" for i, c in enumerate(cols)])
    factors = rows.mapInArrow(_triangles(1 + len(cols)), "scope string, n long, factor array<double>")
    solve = _solver(len(xs), len(zs or []), list(xs), zs is not None)
    return factors.groupBy("scope").applyInPandas(solve, _FIT_SCHEMA)


def ols(df: DataFrame, by: str, y: str, xs: Sequence[str], finite_only: bool = True) -> DataFrame:
    """Coefficient table of y on several regressors and a constant, per group and pooled.

    Rows missing any model variable are left out. A regressor that the constant and the regressors before it
    give, up to a ten-millionth of its length, is left out of the fit: its row is NULL, and the degrees of freedom follow
    from the rank.
    """
    return _fit(df, by, y, list(xs), None, finite_only)


def iv(df: DataFrame, by: str, y: str, xs: Sequence[str], zs: Sequence[str], finite_only: bool = True) -> DataFrame:
    """Two-stage least squares of y on `xs` with instruments `zs`, per group and pooled.

    Standard errors come from the structural residuals. NULL estimates if the instruments do not
    identify the coefficients.
    """
    if len(zs) < len(xs):
        raise ValueError("at least one instrument per regressor is needed")
    return _fit(df, by, y, list(xs), list(zs), finite_only)


def residual_summary(df: DataFrame, by: str, y: str, xs: Sequence[str], finite_only: bool = True) -> DataFrame:
    """Minimum, quartiles and maximum of the residuals of each group's own fit and of the pooled fit."""
    cols = [by, y, *xs]
    source = store(df.select(*dict.fromkeys(cols)))
    table = ols(source, by, y, xs, finite_only)
    coefs = store(
        table.groupBy("scope").agg(
            F.max(F.when(F.col("term") == "(Intercept)", F.col("estimate"))).alias("__b0"),
            *[F.max(F.when(F.col("term") == x, F.col("estimate"))).alias(f"__b{i + 1}") for i, x in enumerate(xs)],
        )
    )

    def number(c: str) -> Column:
        return finite(c) if finite_only else F.col(c).cast("double")

    def residual(b: Sequence[Column]) -> Column:
        # A regressor without an estimate is not in the fit.
        return number(y) - reduce(add, [b[0], *[F.coalesce(b[i + 1], F.lit(0.0)) * number(x) for i, x in enumerate(xs)]])

    def summary(name: str, keys: list[str]) -> DataFrame:
        rows = stored.select(*keys, F.col(name).alias("residual"))
        return describe_by(rows, keys, {"residual": ["min", 0.25, "median", 0.75, "max"]}, stored=True)

    names = [f"__b{i}" for i in range(len(xs) + 1)]
    pooled = coefs.where(F.col("scope") == POOLED).first()
    groups = coefs.where(F.col("scope") != POOLED).withColumnRenamed("scope", by)
    named = source.withColumn("__scope", F.expr(scope_name(by))).drop(by).withColumnRenamed("__scope", by)
    # Both residuals of a row are stored once; a group without a fit, and a missing group, has none of its own.
    stored = store(
        join_groups(named, groups, [by], "left").select(
            by,
            residual([F.lit(pooled[n] if pooled else None).cast("double") for n in names]).alias("__all"),
            residual([F.col(n) for n in names]).alias("__own"),
        )
    )
    whole = summary("__all", []).withColumn("scope", F.lit(POOLED))
    own = summary("__own", [by]).join(groups.select(F.col(by).alias("__fitted")), F.col(by) == F.col("__fitted"), "left_semi")
    return whole.unionByName(own.withColumnRenamed(by, "scope"))
