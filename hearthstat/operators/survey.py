"""Survey designs with multiple imputation and replicate weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from hearthstat.functions.expr import level_index, quoted
from hearthstat.operators.summary import level_grid, one_row


@dataclass(frozen=True)
class Design:
    """Names and constants of a survey design; the rows stay in the DataFrame.

    The replicate weights are whole weights, or with `combined` off factors on the base weight. `rscale` applies to
    every replicate and deviations are taken from the full-sample estimate.
    """

    weight: str
    implicate: str | None = None
    replicates: tuple[str, ...] = ()
    scale: float = 1.0
    rscale: float | None = None
    combined: bool = True

    @property
    def keys(self) -> list[str]:
        """The implicate column, if there is one: a simple design is a single implicate."""
        return [self.implicate] if self.implicate else []

    @property
    def replicate_scale(self) -> float:
        rscale = self.rscale if self.rscale is not None else 1.0 / len(self.replicates)
        return self.scale * rscale


def attach_weights(
    df: DataFrame, weights: DataFrame, keys: Sequence[str], replicates: Sequence[str], missing_keys: bool = True
) -> DataFrame:
    """Add the replicate weights of each household by key; missing weights count as 0.

    A missing key matches a missing key. Without `missing_keys` there are none in either table: the join is then on the
    plain keys and can share a partitioning by them. Give it summed rows where sums are all that is wanted: each row
    becomes as wide as there are replicates. Raises if the weight table has two rows for a household: a check on its keys alone. The job fails if a
    household has no row there.
    """
    keys = list(keys)
    if not weights.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a household has several rows of replicate weights")
    names = {k: f"__w_{i}" for i, k in enumerate(keys)}
    right = weights.selectExpr(
        *[f"{quoted(k)} AS {n}" for k, n in names.items()],
        *[f"coalesce({quoted(r)}, 0D) AS {quoted(r)}" for r in replicates],
        "true AS __found",
    )
    conds = [df[k].eqNullSafe(right[n]) if missing_keys else df[k] == right[n] for k, n in names.items()]
    joined = df.join(right, conds, "left")
    present = "CASE WHEN __found THEN true ELSE boolean(raise_error('household without replicate weights')) END"
    return joined.where(present).drop("__found", *names.values())


def weighted_table(df: DataFrame, levels: Mapping[str, Sequence], design: Design, name: str = "weighted_count") -> DataFrame:
    """Sum of the base weight per implicate and cell, dense over the declared levels.

    Rows with a missing or unknown level in any dimension belong to no cell.
    """
    cells = _cells(df, levels, design.keys, {name: design.weight})
    # One map per implicate, as long as there are cells: the grid is filled without a second scan.
    cell = ", ".join(f"'{i}', {quoted(d)}" for i, d in enumerate(levels))
    held = f"map_from_entries(collect_list(named_struct('k', named_struct({cell}), 'w', {quoted(name)}))) AS __cells"
    grid = level_grid(cells.groupBy(*design.keys).agg(F.expr(held)), levels)
    weight = f"coalesce(try_element_at(__cells, named_struct({cell})), 0D) AS {quoted(name)}"
    return grid.selectExpr(*map(quoted, [*design.keys, *levels]), weight)


def _cells(df: DataFrame, levels: Mapping[str, Sequence], keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Weight sums per key and cell; rows outside the levels fall into a cell of NULLs.

    A row with a missing key belongs to no implicate and is left out.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    dims = [F.when(F.col(d).isin(*lv), F.col(d)).alias(d) for d, lv in levels.items()]
    return (
        df.select(*keys, *dims, *sums.values())
        .groupBy(*keys, *levels)
        .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    )


def implicate_mean(df: DataFrame, levels: Mapping[str, Sequence], design: Design, name: str = "weighted_count") -> DataFrame:
    """Weighted table averaged over the implicates of the whole table, dense over the levels.

    A cell that is absent from an implicate counts as 0 there.
    """
    dims = list(levels)
    cells = _cells(df, levels, design.keys, {name: design.weight})
    # From here on: at most (implicates x cells) rows.
    every = [F.collect_set(k).over(Window.partitionBy(F.lit(1))) for k in design.keys]
    implicates = F.size(every[0]) if every else F.lit(1)
    mean = (
        cells.withColumn("__m", implicates)
        .groupBy(*dims)
        .agg((F.sum(name) / F.first("__m")).alias(name))
    )
    grid = level_grid(one_row(df), {f"__{d}": lv for d, lv in levels.items()})
    on = [grid[f"__{d}"] == mean[d] for d in dims]
    return grid.join(mean, on, "left").select(
        *[F.col(f"__{d}").alias(d) for d in dims], F.coalesce(F.col(name), F.lit(0.0)).alias(name)
    )


def share(table: DataFrame, value: str, within: Sequence[str], name: str = "proportion") -> DataFrame:
    """Share of each row in the total of its group; NULL where the total is 0. For aggregated rows."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return table.withColumn(name, F.try_divide(F.col(value), total))


def in_level_order(table: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Sort a result by the order of the declared levels, for output."""
    return table.orderBy(*[level_index(d, lv) for d, lv in levels.items()])


def replicate_variance(
    df: DataFrame, levels: Mapping[str, Sequence], design: Design, within: Sequence[str]
) -> DataFrame:
    """Totals and shares per cell, with the replicate-weight variance of both, where each row has its replicate weights.

    One pass sums all weight columns side by side: no row is repeated per replicate. Variances are
    the scaled squared deviations of the replicate results from the full-sample result. With an
    implicate column all results are averages over the implicates. For many replicates, or where rows share
    those of their household, see `household_replicate_variance`.
    """
    sums = {"__0": design.weight, **{f"__{r + 1}": c for r, c in enumerate(design.replicates)}}
    cells = _cells(df, levels, design.keys, sums)
    return _deviations(cells.select(*design.keys, *levels, F.array(*sums).alias("__totals")), levels, design, within)


def replicate_vectors(weights: DataFrame, keys: Sequence[str], replicates: Sequence[str], name: str = "replicates") -> DataFrame:
    """The weight table with its replicate weights as one array, missing ones as 0."""
    return weights.selectExpr(*map(quoted, keys), f"array({', '.join(f'coalesce(double({quoted(r)}), 0D)' for r in replicates)}) AS {quoted(name)}")


def household_replicate_variance(
    df: DataFrame, vectors: DataFrame, on: Sequence[str], levels: Mapping[str, Sequence], design: Design, within: Sequence[str],
    vector: str = "replicates", missing_keys: bool = True,
) -> DataFrame:
    """The same from rows that share the replicate weights of their household: `vectors` has an array for each.

    The rows of a household become its few sums (one for each implicate and cell), and a household is joined once, with
    one row as wide as there are replicates, however many implicates it has. The arrays are then summed element by
    element, with partial sums in each task, so that the number of replicates does not show in the plan.

    A missing key matches a missing key. A household without weights, or with several rows of them, fails the job. Missing
    replicate weights count as 0.
    """
    cells = _vector_sums(df, vectors, list(on), levels, design, vector, missing_keys)
    return _deviations(cells, levels, design, within)


def _vector_sums(df, vectors, on, levels, design, vector, missing_keys) -> DataFrame:
    """Per implicate and cell the totals of the base weight and of all replicates, as one array."""
    for k in design.keys:
        df = df.where(F.col(k).isNotNull())
    house = {f"__h{i}": F.col(k) for i, k in enumerate(on)}
    parts = {f"__k{i}": F.col(k) for i, k in enumerate(design.keys)}
    parts |= {f"__d{i}": F.when(F.col(d).isin(*lv), F.col(d)) for i, (d, lv) in enumerate(levels.items())}
    narrow = df.select(*[c.alias(n) for n, c in (house | parts).items()], F.col(design.weight).cast("double").alias("__w"))
    sums = narrow.groupBy(*house, *parts).agg(F.coalesce(F.sum("__w"), F.lit(0.0)).alias("__w"), F.count(F.lit(1)).cast("double").alias("__c"))
    own = sums.groupBy(*house).agg(F.collect_list(F.struct(*parts, "__w", "__c")).alias("__entries"))
    # One row per household, so the join cannot repeat rows; the count tells whether there were more.
    wide = vectors.select(*[F.col(k).alias(f"__of{i}") for i, k in enumerate(on)], F.col(vector).alias("__v"))
    wide = wide.groupBy(*[f"__of{i}" for i in range(len(on))]).agg(F.first("__v").alias("__v"), F.count(F.lit(1)).alias("__n"))
    conds = [own[h].eqNullSafe(wide[f"__of{i}"]) if missing_keys else own[h] == wide[f"__of{i}"] for i, h in enumerate(house)]
    checked = "CASE WHEN __n = 1 THEN true WHEN __n > 1 THEN boolean(raise_error('household with several rows of replicate weights')) ELSE boolean(raise_error('household without replicate weights')) END"
    joined = own.join(wide, conds, "left").where(checked)
    values = F.transform("__v", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    rows = joined.select(array_to_vector(values).alias("__x"), F.inline("__entries"))
    # A sum with weights takes positive ones only; what weighs nothing adds nothing.
    times = F.col("__c" if design.combined else "__w")
    none = array_to_vector(F.transform(vector_to_array("__x"), lambda x: F.lit(0.0)))
    rows = rows.select(*parts, "__w", F.when(times == 0, none).otherwise(F.col("__x")).alias("__x"), F.when(times == 0, 1.0).otherwise(times).alias("__t"))
    cells = rows.groupBy(*parts).agg(F.sum("__w").alias("__0"), Summarizer.sum(F.col("__x"), F.col("__t")).alias("__s"))
    names = dict(zip(parts, [*design.keys, *levels]))
    return cells.select(*[F.col(n).alias(c) for n, c in names.items()], F.concat(F.array("__0"), vector_to_array("__s")).alias("__totals"))


def _deviations(cells: DataFrame, levels: Mapping[str, Sequence], design: Design, within: Sequence[str]) -> DataFrame:
    """Totals, shares and their variances from one row per implicate and cell: `__totals` has the full sample first."""
    dims = list(levels)
    # (implicates x cells x replicates) rows from here on.
    long = cells.select(*design.keys, *dims, F.posexplode("__totals").alias("replicate", "total"))
    if design.keys:
        implicates = F.size(F.collect_set(design.keys[0]).over(Window.partitionBy("replicate")))
        long = long.withColumn("__m", implicates).groupBy(*dims, "replicate")
        long = long.agg((F.sum("total") / F.first("__m")).alias("total"))
    long = long.where(" AND ".join(f"{quoted(d)} IS NOT NULL" for d in dims))
    long = share(long, "total", [*within, "replicate"], "share")
    full = Window.partitionBy(*dims)
    at_full = {c: F.max(F.when(F.col("replicate") == 0, F.col(c))).over(full) for c in ("total", "share")}
    long = long.withColumns({f"full_{c}": e for c, e in at_full.items()}).where("replicate > 0")
    each = F.lit(design.rscale) if design.rscale is not None else 1 / F.count(F.lit(1))

    def variance(c: str):
        return F.sum(F.pow(F.col(c) - F.col(f"full_{c}"), 2)) * F.lit(design.scale) * each

    return long.groupBy(*dims).agg(
        F.first("full_total").alias("total"),
        variance("total").alias("var_total"),
        F.first("full_share").alias("share"),
        variance("share").alias("var_share"),
    )
