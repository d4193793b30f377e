"""SQL counterparts of the registered queries, for an independent engine on the same tables.

Written from the definitions, not from the Spark plans: medians and quantiles come from the engine's
own exact functions, fits from closed forms or from a chain of sweeps on the cross-product matrix.
"""

from __future__ import annotations

from hearthstat.plans.queries import CONTROLS, INCOMES, PAIRS, PARTS, STRICT, WEIGHTED_STATS
from hearthstat.plans.variables import (
    AGE_BREAKS,
    AGE_LEVELS,
    CHANGE_LEVELS,
    FAMILY_LABELS,
    INCOME_NAMES,
    QUINTILES,
    REGION_NAMES,
    YEAR_LEVELS,
)
from hearthstat.sources.house import COUNTRIES, REGION_CODES

ORACLE_SQL: dict[str, str] = {}


def _text(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(column: str, names: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {column} = {k!r} THEN '{t}'" for k, t in names.items())
    return f"CASE {whens} ELSE {default} END"


def _r(expr: str, digits: int, name: str) -> str:
    # A hundredth of the last digit keeps exact decimal halves from falling either way; adding 0 turns -0 into 0.
    return f"round({expr} + 1e-{digits + 2}::DOUBLE, {digits}) + 0.0 AS {name}"


def _grid(levels: dict[str, list[str]]) -> str:
    parts = [f"(SELECT unnest([{_text(v)}]) AS {k})" for k, v in levels.items()]
    return "SELECT * FROM " + " CROSS JOIN ".join(parts)


# The two CASE branches of a null rule: value unless the key is a multiple.
def _nul(k: int, key: str, expr: str) -> str:
    return f"CASE WHEN {key} % {k} <> 0 THEN {expr} END"


HOUSE = f"""house AS (
  SELECT l_orderkey AS id, l_linenumber AS person_no, 1 + l_suppkey % 5 AS im0100,
    CASE r_name WHEN 'ASIA' THEN 'AT' WHEN 'EUROPE' THEN 'DE' ELSE r_name END AS sa0100,
    {_case("n_name", REGION_CODES)} AS dhregion,
    l_quantity AS hw0010,
    CASE WHEN l_orderkey % 97 = 0 THEN 0.0::DOUBLE WHEN l_orderkey % 13 <> 0 THEN p_retailprice * 25 END AS hb0800,
    {_nul(13, "l_orderkey", "l_extendedprice")} AS hb0900,
    {_nul(11, "l_orderkey", "1960 + 9 * (year(o_orderdate) - 1995)")} AS hb0700,
    {_nul(31, "l_partkey", "p_size::DOUBLE")} AS hb0100,
    c_acctbal AS netliquidassets, o_totalprice AS networth,
    c_acctbal / nullif(l_extendedprice, 0) AS dnnlaratio,
    18 + c_custkey % 68 AS agerefperson, left(o_orderpriority, 1)::INTEGER AS edurefperson,
    1 + c_custkey % 2 AS dhgenderh1,
    {_nul(19, "l_partkey", "18 + l_partkey % 70")} AS age,
    {_nul(29, "l_partkey", "1 + l_suppkey % 2")} AS ra0200,
    {_nul(23, "l_partkey", "1 + l_partkey % 5")} AS pa0100,
    {_nul(17, "l_partkey", "l_suppkey % 7")} AS pa0200,
    {_nul(37, "l_partkey", "1 + l_linenumber % 3")} AS pe0100a,
    l_linenumber::DOUBLE AS dh0001,
    {_nul(21, "l_partkey", "l_linenumber::DOUBLE - (l_orderkey % 4 - 1)")} AS dh0006,
    {_nul(3, "l_partkey", "l_extendedprice * l_tax")} AS di1100,
    {_nul(6, "l_partkey", "l_extendedprice * l_tax * 0.5::DOUBLE")} AS di1200,
    {_nul(10, "l_partkey", "l_quantity * l_tax * 100")} AS di1300,
    {_nul(12, "l_partkey", "c_acctbal * 0.02::DOUBLE")} AS di1400,
    {_nul(2, "l_partkey", "l_discount * 1000")} AS di1420,
    {_nul(5, "l_partkey", "l_extendedprice * 0.05::DOUBLE")} AS di1500,
    {_nul(4, "l_partkey", "l_extendedprice * l_discount")} AS di1600,
    {_nul(15, "l_partkey", "l_quantity * 10")} AS di1700,
    l_extendedprice * (1 + l_tax) AS di2000,
    {_nul(8, "l_partkey", "c_acctbal * 1.5::DOUBLE + l_quantity")} AS da2101,
    l_extendedprice * (1 - l_discount) AS docogood,
    {_nul(41, "l_partkey", "l_extendedprice * (1 - l_discount) / nullif(o_totalprice, 0)")} AS docogoodp,
    l_extendedprice * l_tax * 0.25::DOUBLE AS dofoodc, l_quantity * 30 AS hi0210, o_custkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  WHERE r_name IN ('ASIA', 'EUROPE'))"""

# The same records of all countries.
WORLD = HOUSE.replace("WHERE r_name IN ('ASIA', 'EUROPE')", "")

# change_ratio is the finite ratio; a positive value over zero is infinite and only binned.
CHANGES = f"""{HOUSE}, changes AS (
  SELECT *, CASE WHEN hb0800 <> 0 THEN hb0900 / hb0800 END AS change_ratio,
    hb0900 - hb0800 AS change_absolute,
    CASE WHEN hb0800 = 0 AND hb0900 > 0 THEN 'Increase > 100%'
      WHEN hb0800 = 0 OR hb0900 / nullif(hb0800, 0) < 0 THEN NULL
      WHEN hb0900 / hb0800 <= 0.5 THEN 'Decrease > 50%' WHEN hb0900 / hb0800 <= 1 THEN 'Decrease 0-50%'
      WHEN hb0900 / hb0800 <= 1.5 THEN 'Increase 0-50%' WHEN hb0900 / hb0800 <= 2 THEN 'Increase 50-100%'
      WHEN hb0900 / hb0800 > 2 THEN 'Increase > 100%' END AS change_category,
    CASE WHEN hb0700 < 1980 THEN 'Before 1980' WHEN hb0700 < 1990 THEN '1980-1989'
      WHEN hb0700 < 2000 THEN '1990-1999' WHEN hb0700 < 2010 THEN '2000-2009'
      WHEN hb0700 >= 2010 THEN '2010+' END AS year_acquisition_category,
    coalesce(2021 - hb0700, 0) AS age_main_residence,
    docogood / nullif(dh0001, 0) AS per_capita_consumption,
    dofoodc + hi0210 * 12 + docogood AS total_c
  FROM house)"""
KNOWN = f"{CHANGES}, known AS (SELECT * FROM changes WHERE change_category IS NOT NULL)"


# ---- survey tables -------------------------------------------------------------------------------------


def _weighted(dims: dict[str, list[str]], within: str) -> str:
    names = ", ".join(dims)
    match = " AND ".join(f"g.{d} = c.{d}" for d in dims)
    return f"""WITH {CHANGES}, m AS (SELECT count(DISTINCT im0100) AS m FROM house),
    c AS (SELECT {names}, sum(hw0010) AS w FROM changes GROUP BY ALL),
    g AS ({_grid(dims)}),
    t AS (SELECT {", ".join("g." + d for d in dims)}, coalesce(c.w, 0) / (SELECT m FROM m) AS w
      FROM g LEFT JOIN c ON {match})
    SELECT {names}, {_r("w", 6, "weighted_count")},
      {_r(f"w / nullif(sum(w) OVER (PARTITION BY {within}), 0)", 10, "proportion")} FROM t"""


ORACLE_SQL["weighted_distribution"] = _weighted(
    {"change_category": CHANGE_LEVELS, "sa0100": COUNTRIES}, "sa0100"
)
ORACLE_SQL["weighted_distribution_by_year"] = _weighted(
    {"change_category": CHANGE_LEVELS, "year_acquisition_category": YEAR_LEVELS, "sa0100": COUNTRIES},
    "sa0100, year_acquisition_category",
)
ORACLE_SQL["weighted_table_by_implicate"] = f"""WITH {CHANGES},
  g AS (SELECT * FROM (SELECT DISTINCT im0100 FROM house), ({_grid({"change_category": CHANGE_LEVELS, "sa0100": COUNTRIES})})),
  c AS (SELECT im0100, change_category, sa0100, sum(hw0010) AS w FROM changes GROUP BY ALL)
  SELECT im0100, change_category, sa0100, {_r("coalesce(w, 0)", 6, "weighted_count")}
  FROM g LEFT JOIN c USING (im0100, change_category, sa0100)"""
ORACLE_SQL["simple_design_table"] = f"""WITH {CHANGES}, g AS ({_grid({"change_category": CHANGE_LEVELS, "sa0100": COUNTRIES})}),
  c AS (SELECT change_category, sa0100, sum(hw0010) AS w FROM changes GROUP BY ALL)
  SELECT change_category, sa0100, {_r("coalesce(w, 0)", 6, "weighted_count")} FROM g LEFT JOIN c USING (change_category, sa0100)"""
ORACLE_SQL["weighted_distribution_missing_implicates"] = ORACLE_SQL["weighted_distribution"].replace(
    "FROM house)", "FROM house WHERE id % 23 <> 0)"
).replace("FROM changes GROUP BY ALL", "FROM changes WHERE id % 23 <> 0 GROUP BY ALL")
ORACLE_SQL["replicate_variance_share"] = f"""WITH {CHANGES},
  m AS (SELECT count(DISTINCT im0100) AS m FROM house),
  r AS (SELECT unnest(range(0, 101)) AS r),
  c AS (SELECT change_category, sa0100, r,
      sum(CASE WHEN r = 0 THEN hw0010 ELSE hw0010 * (1 + (id * r + o_custkey) % 3) / 2 END) / (SELECT m FROM m) AS total
    FROM changes, r WHERE change_category IS NOT NULL GROUP BY ALL),
  s AS (SELECT *, total / sum(total) OVER (PARTITION BY sa0100, r) AS share FROM c),
  f AS (SELECT * FROM s WHERE r = 0)
  SELECT change_category, sa0100, {_r("any_value(f.total)", 6, "total")},
    {_r("sum((s.total - f.total) ** 2) / 100", 4, "var_total")},
    {_r("any_value(f.share)", 10, "share")}, {_r("sum((s.share - f.share) ** 2) / 100", 12, "var_share")}
  FROM s JOIN f USING (change_category, sa0100) WHERE s.r > 0 GROUP BY change_category, sa0100"""

_KEYED = """l_orderkey * 10 + l_linenumber AS id, l_orderkey AS hh, l_linenumber AS im,
      CASE l_orderkey % 3 WHEN 0 THEN 'AT' WHEN 1 THEN 'DE' ELSE 'FR' END AS "SA0100\""""
ORACLE_SQL["survey_pipeline"] = f"""WITH d AS (SELECT {_KEYED}, l_quantity AS w FROM lineitem),
  h AS (SELECT {_KEYED}, CASE WHEN l_suppkey % 29 = 0 THEN l_quantity + 1 ELSE l_quantity END AS w,
      CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity * 1000 END AS hb0800,
      CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice * (1 + l_suppkey % 3) / 2 END AS hb0900 FROM lineitem),
  p AS (SELECT l_orderkey * 10 + l_linenumber AS hid FROM lineitem),
  base AS (SELECT d.*, hb0900 / hb0800 AS ratio FROM d LEFT JOIN h ON d.id = h.id AND d.w = h.w LEFT JOIN p ON d.id = p.hid
    WHERE d."SA0100" <> 'FR'),
  wide AS (SELECT *, CASE WHEN ratio <= 0.5 THEN 'Decrease > 50%' WHEN ratio <= 1 THEN 'Decrease 0-50%'
      WHEN ratio <= 1.5 THEN 'Increase 0-50%' WHEN ratio <= 2 THEN 'Increase 50-100%' WHEN ratio > 2 THEN 'Increase > 100%' END
      AS change_category FROM base JOIN orders ON hh = o_orderkey),
  r AS (SELECT unnest(range(0, 11)) AS r),
  c AS (SELECT change_category, "SA0100", r, sum(CASE WHEN r = 0 THEN w WHEN o_custkey % 7 = 0 AND r % 2 = 0 THEN 0
      ELSE 10 * (1 + (o_orderkey * r + o_custkey) % 3) END) / (SELECT count(DISTINCT im) FROM base) AS total
    FROM wide, r WHERE change_category IS NOT NULL GROUP BY ALL),
  s AS (SELECT *, total / sum(total) OVER (PARTITION BY "SA0100", r) AS share FROM c),
  f AS (SELECT * FROM s WHERE r = 0)
  SELECT change_category, "SA0100", {_r("any_value(f.total)", 6, "total")},
    {_r("sum((s.total - f.total) ** 2) / 10", 4, "var_total")},
    {_r("any_value(f.share)", 10, "share")}, {_r("sum((s.share - f.share) ** 2) / 10", 12, "var_share")}
  FROM s JOIN f USING (change_category, "SA0100") WHERE s.r > 0 GROUP BY change_category, "SA0100\""""

# ---- summaries -----------------------------------------------------------------------------------------

_STATS = {
    "mean": ("avg({0})", 4),
    "median": ("median({0}::DOUBLE)", 8),
    "sd": ("stddev_samp({0})", 4),
    "var": ("var_samp({0})", 0),
}


def _stat(stat, column: str, digits: dict | int | None = None) -> str:
    if isinstance(stat, str):
        sql, d = _STATS[stat]
        name = f"{stat}_{column}"
    else:
        sql, d, name = f"quantile_cont({{0}}::DOUBLE, {stat})", 8, f"p{round(stat * 100)}_{column}"
    if digits is not None:
        d = digits if isinstance(digits, int) else digits.get(name, d)
    return _r(sql.format(column), d, name)


def _weighted_stat(stat, c: str, over: str = "{}") -> str:
    pick = f"min({c}) FILTER (WHERE {c}_upto >= {{0}} * (1 - 1e-12) * {c}_whole)"
    n, mean = f"count({c})", f"sum(w * {c}) / sum(w) FILTER (WHERE {c} IS NOT NULL)"
    var = f"sum(w * ({c} - {c}_mean) ** 2) / sum(w) FILTER (WHERE {c} IS NOT NULL) * {n} / ({n} - 1)"
    sql = {"mean": mean, "median": pick.format(0.5), "var": var, "sd": f"sqrt({var})"}.get(stat) or pick.format(stat)
    name = f"{stat}_{c}" if isinstance(stat, str) else f"p{round(stat * 100)}_{c}"
    return f"{over.format(sql)} AS {name}"


def _weighted_summary(weight: str, average: bool) -> str:
    """Cumulated weights by window, then per country and implicate; at last the mean over the implicates."""
    cols = list(WEIGHTED_STATS)
    by = "PARTITION BY sa0100, im0100"
    valid = ", ".join(f"CASE WHEN {weight} > 0 THEN {c}::DOUBLE END AS {c}" for c in cols)
    windows = ", ".join(
        f"sum(CASE WHEN {c} IS NOT NULL THEN w END) OVER ({by} ORDER BY {c}) AS {c}_upto, "
        f"sum(CASE WHEN {c} IS NOT NULL THEN w END) OVER ({by}) AS {c}_whole, "
        f"sum(w * {c}) OVER ({by}) / sum(CASE WHEN {c} IS NOT NULL THEN w END) OVER ({by}) AS {c}_mean"
        for c in cols
    )
    names = {(s, c): (f"{s}_{c}" if isinstance(s, str) else f"p{round(s * 100)}_{c}") for c in cols for s in WEIGHTED_STATS[c]}
    digits = {"mean": 4, "median": 8, "sd": 4, "var": 0}
    each = f"""WITH {KNOWN}, valid AS (SELECT sa0100, im0100, {weight}::DOUBLE AS w, {valid} FROM known),
      summed AS (SELECT *, {windows} FROM valid),
      each AS (SELECT sa0100, im0100, {", ".join(_weighted_stat(s, c) for s, c in names)}, count(*) AS n FROM summed GROUP BY sa0100, im0100)"""
    out = ", ".join(_r(f"avg({name})" if average else name, digits.get(s, 8), name) for (s, _), name in names.items())
    if average:
        return f"{each} SELECT sa0100, {out}, {_r('sum(n) / (SELECT count(DISTINCT im0100) FROM each)', 6, 'n')} FROM each GROUP BY sa0100"
    return f"{each} SELECT sa0100, im0100, {out}, n FROM each"


def _summary(source: str, by: list[str], measures: dict, count: bool = True, digits=None, table: str = "known") -> str:
    stats = [_stat(s, c, digits) for c, ss in measures.items() for s in ss]
    n = ["count(*) AS n"] if count else []
    return f"WITH {source} SELECT {', '.join([*by, *stats, *n])} FROM {table} GROUP BY {', '.join(by)}"


_MMS = ["mean", "median", "sd"]
ORACLE_SQL["change_summary"] = _summary(
    KNOWN, ["sa0100"], {"change_ratio": _MMS, "change_absolute": _MMS}
)
_WEALTH = [*_MMS, "var", 0.1, 0.25, 0.5, 0.75, 0.9]
ORACLE_SQL["wealth_summary"] = _summary(KNOWN, ["sa0100"], {"netliquidassets": _WEALTH, "networth": _WEALTH})
ORACLE_SQL["weighted_wealth_by_implicate"] = _weighted_summary("hw0010", average=False)
ORACLE_SQL["weighted_wealth_summary"] = _weighted_summary("CASE WHEN id % 29 <> 0 THEN hw0010 END", average=True)
_EACH = [(f, f"{n}_{c}", d) for c in ("netliquidassets", "networth") for n, f, d in (
    ("mean", f"avg({c})", 4), ("median", f"median({c}::DOUBLE)", 8), ("sd", f"stddev_samp({c})", 4),
    ("p10", f"quantile_cont({c}::DOUBLE, 0.1)", 8), ("p90", f"quantile_cont({c}::DOUBLE, 0.9)", 8))]
ORACLE_SQL["wealth_summary_by_implicate"] = f"""WITH {KNOWN},
  each AS (SELECT sa0100, im0100, {", ".join(f"{f} AS {name}" for f, name, _ in _EACH)}, count(*) AS n FROM known GROUP BY sa0100, im0100)
  SELECT sa0100, {", ".join(_r(f"avg({name})", d, name) for _, name, d in _EACH)},
    {_r("sum(n) / (SELECT count(DISTINCT im0100) FROM each)", 6, "n")} FROM each GROUP BY sa0100"""
ORACLE_SQL["refperson_summary"] = _summary(
    KNOWN, ["sa0100"], {"agerefperson": _MMS, "edurefperson": _MMS}, digits=8
)
_age_case = " ".join(
    f"WHEN agerefperson <= {hi} THEN '{label}'" for hi, label in zip(AGE_BREAKS[1:], AGE_LEVELS)
)
PROFILED = f"""{KNOWN}, profiled AS (SELECT *, {_case("dhregion", REGION_NAMES, "dhregion")} AS region,
    CASE WHEN agerefperson < {AGE_BREAKS[0]} THEN NULL {_age_case} END AS age_group,
    change_absolute / nullif(hb0100, 0) AS change_per_sqm FROM known)"""
_PROFILE = {
    "change_absolute": [*_MMS, "var"],
    **{c: ["mean", "median"] for c in ("agerefperson", "edurefperson", "netliquidassets", "networth", "hb0100", "change_per_sqm")},
}
ORACLE_SQL["region_profile"] = _summary(PROFILED, ["sa0100", "region"], _PROFILE, False, table="profiled")
ORACLE_SQL["region_age_profile"] = _summary(
    PROFILED, ["sa0100", "region", "age_group"], _PROFILE, False, table="profiled"
)
ORACLE_SQL["extreme_profiles"] = f"""WITH {PROFILED}, p AS (
    SELECT sa0100, region, age_group, avg(change_absolute) AS mean_change_absolute,
      median(change_absolute) AS median_change_absolute FROM profiled GROUP BY ALL),
  l AS (SELECT sa0100, region, age_group, 'mean_change_absolute' AS measure, mean_change_absolute AS value FROM p
    UNION ALL SELECT sa0100, region, age_group, 'median_change_absolute', median_change_absolute FROM p),
  e AS (SELECT sa0100, measure, max(value) AS hi, min(value) AS lo FROM l GROUP BY ALL)
  SELECT sa0100, region, age_group, measure, {_r("value", 4, "value")}, 'max' AS extreme
    FROM l JOIN e USING (sa0100, measure) WHERE value = hi
  UNION ALL SELECT sa0100, region, age_group, measure, {_r("value", 4, "value")}, 'min'
    FROM l JOIN e USING (sa0100, measure) WHERE value = lo"""
FLAGGED = f"""{KNOWN}, flagged AS (SELECT *,
    CASE WHEN change_category = 'Increase > 100%' THEN 1 ELSE 0 END AS significant_increase FROM known)"""
ORACLE_SQL["behaviour_summary"] = _summary(
    FLAGGED, ["significant_increase", "sa0100"], {"total_c": _MMS, "da2101": _MMS}, table="flagged"
)


def _plus(cols) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


_CODE = {name: code for code, name in INCOME_NAMES.items()}
_core = [_CODE[n] for n in ("employee_income", "social_transfers", "private_transfers", "pension_incomes")]
_rest = [c for c in INCOMES if c not in _core]
_INCOMES = f"""incomes AS (SELECT *, {_plus(_core)} AS income, {_plus(_core)} + {_plus(_rest)} AS income_psid,
    {_plus(INCOMES)} AS total_gross_income"""
INCOME = f"{WORLD}, {_INCOMES} FROM house)"
ORACLE_SQL["mpc_by_status"] = f"""WITH {KNOWN}, {_INCOMES} FROM known), s AS (SELECT
    CASE WHEN netliquidassets <= total_gross_income / 24 THEN 1 ELSE 0 END AS htm_status,
    di2000 / nullif(total_gross_income, 0) AS mpc FROM incomes)
  SELECT htm_status, {_r("median(mpc)", 8, "median_mpc")}, {_r("avg(mpc)", 6, "mean_mpc")} FROM s GROUP BY 1"""
ORACLE_SQL["null_profile"] = f"WITH {HOUSE} " + " UNION ALL ".join(
    f"""SELECT sa0100, '{c}' AS variable, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
      {_r(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)", 10, "share_missing")} FROM house GROUP BY sa0100"""
    for c in ("hb0800", "hb0900", "hb0700", "da2101")
)
ORACLE_SQL["six_number_summary"] = f"WITH {INCOME} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, {_r(f"min({c})", 7, "minimum")}, {_r(f"quantile_cont({c}, 0.25)", 7, "q1")},
      {_r(f"median({c})", 7, "median")}, {_r(f"avg({c})", 4, "mean")}, {_r(f"quantile_cont({c}, 0.75)", 7, "q3")},
      {_r(f"max({c})", 7, "maximum")}, count(*) - count({c}) AS n_missing FROM incomes"""
    for c in ("income", "income_psid", "total_gross_income", "di2000")
)
ORACLE_SQL["value_ranges"] = f"""WITH {KNOWN}
  SELECT sa0100, min(hb0700)::INTEGER AS lowest, max(hb0700)::INTEGER AS highest FROM known GROUP BY sa0100"""
ORACLE_SQL["crosstab_counts"] = f"""WITH {CHANGES},
  lv AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(CHANGE_LEVELS, 1))}) t(change_category, o)
    UNION ALL SELECT NULL, 6 WHERE EXISTS (SELECT 1 FROM changes WHERE change_category IS NULL)),
  co AS (SELECT * FROM (VALUES ('AT', 1), ('DE', 2)) t(sa0100, p)),
  c AS (SELECT sa0100, change_category, count(*) AS n FROM changes GROUP BY ALL)
  SELECT co.sa0100, lv.change_category, coalesce(c.n, 0) AS n, p::BIGINT AS order_sa0100, o::BIGINT AS order_change_category
  FROM co CROSS JOIN lv LEFT JOIN c ON c.sa0100 = co.sa0100 AND c.change_category IS NOT DISTINCT FROM lv.change_category"""
ORACLE_SQL["acquisition_counts"] = f"""WITH {KNOWN},
  lv AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(YEAR_LEVELS, 1))}) t(period, o)
    UNION ALL SELECT NULL, 6 WHERE EXISTS (SELECT 1 FROM known WHERE hb0700 IS NULL)),
  c AS (SELECT year_acquisition_category AS period, count(*) AS n FROM known GROUP BY ALL)
  SELECT lv.period, coalesce(c.n, 0) AS n, o::BIGINT AS order_period
  FROM lv LEFT JOIN c ON c.period IS NOT DISTINCT FROM lv.period"""

# ---- preparation ---------------------------------------------------------------------------------------

ORACLE_SQL["stack_implicates"] = " UNION ALL ".join(
    f'SELECT {key} AS "ID", {i} AS "IM0100", {value} AS "VALUE" FROM {name}'
    for i, (name, key, value, _) in enumerate(PARTS, 1)
)
ORACLE_SQL["attach_reference_person"] = """WITH k AS (
    SELECT *, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey + 1000 END AS hh,
      CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / 4 END AS w FROM orders),
  h AS (SELECT * REPLACE (CASE WHEN o_orderstatus <> 'P' THEN hh END AS hh) FROM k),
  p AS (SELECT * FROM lineitem WHERE l_linenumber = 1)
  SELECT k.o_orderkey AS "ID", 1 + k.o_orderkey % 5 AS "IM0100", k.hh AS "SA0010", k.o_totalprice AS "DN3001",
    year(h.o_orderdate)::INTEGER AS "HB0700", l_orderkey * 10 + l_linenumber AS "PERSON_ID", l_quantity AS "PA0200"
  FROM k LEFT JOIN h ON k.o_orderkey = h.o_orderkey AND k.hh IS NOT DISTINCT FROM h.hh AND k.w IS NOT DISTINCT FROM h.w
    LEFT JOIN p ON k.o_orderkey = l_orderkey"""
ORACLE_SQL["income_aggregates"] = f"""WITH {INCOME} SELECT id, person_no,
  {", ".join(_r(c, 6, c) for c in ("income", "income_psid", "total_gross_income"))} FROM incomes"""
_married = "CASE WHEN pa0100 IN (2, 3) THEN 1 ELSE 0 END"
ORACLE_SQL["person_indicators"] = f"""WITH {WORLD} SELECT
    CASE WHEN ra0200 IS NOT NULL THEN (ra0200 = 1)::INTEGER END AS female, pa0200 AS edcat,
    CASE WHEN pe0100a IS NOT NULL THEN (pe0100a = 1)::INTEGER END AS working, {_married} AS married,
    CASE WHEN pa0200 >= 5 THEN 1 ELSE 0 END AS college, count(*) AS n FROM house GROUP BY ALL"""
ORACLE_SQL["age_bands"] = f"""WITH {WORLD} SELECT age,
    CASE WHEN age >= 20 AND age < 80 THEN (age // 5 - 3)::INTEGER ELSE 0 END AS agedum, count(*) AS n
  FROM house GROUP BY ALL"""
FAMILY = f"""{KNOWN}, fam AS (SELECT *, {_married} AS married, dh0001 - dh0006 AS children FROM known)"""
_FAMSTRUCT = """CASE WHEN married = 0 AND children > 0 THEN 1 WHEN married = 0 AND children = 0 AND age <= 55 THEN 2
    WHEN married = 0 AND children = 0 AND age > 55 THEN 3 WHEN married = 1 AND children > 0 THEN 4
    WHEN married = 1 AND children = 0 THEN 5 END"""
ORACLE_SQL["family_structure"] = f"""WITH {WORLD},
  fam AS (SELECT *, {_married} AS married, dh0001 - dh0006 AS children FROM house),
  s AS (SELECT married, children, {_FAMSTRUCT} AS famstruct FROM fam)
  SELECT married, children, famstruct, {_case("famstruct", FAMILY_LABELS)} AS family, count(*) AS n FROM s GROUP BY ALL"""
ORACLE_SQL["residence_age_counts"] = f"""WITH {KNOWN}
  SELECT sa0100, age_main_residence::INTEGER AS age_main_residence, count(*) AS n FROM known GROUP BY ALL"""
ORACLE_SQL["region_recode"] = f"""WITH {HOUSE} SELECT dhregion, {_case("dhregion", REGION_NAMES, "dhregion")} AS region,
  count(*) AS n FROM house GROUP BY ALL"""
TRIMMED = f"""{KNOWN}, q AS (SELECT quantile_cont(netliquidassets, 0.99) AS a, quantile_cont(networth, 0.99) AS b,
    quantile_cont(change_absolute, 0.99) AS c FROM known),
  trimmed AS (SELECT * FROM known, q WHERE netliquidassets <= a AND networth <= b AND change_absolute <= c)"""
ORACLE_SQL["trim_top1"] = f"""WITH {TRIMMED}
  SELECT id, person_no, sa0100, netliquidassets, networth, change_absolute FROM trimmed"""
ORACLE_SQL["trim_5_95"] = f"""WITH {KNOWN},
  q AS (SELECT quantile_cont(di2000, 0.05) AS a, quantile_cont(di2000, 0.95) AS b FROM known)
  SELECT id, person_no, {_r("di2000", 6, "di2000")} FROM known, q WHERE di2000 BETWEEN a AND b"""


def _box(source: str, table: str, by: str, value: str, digits: int) -> str:
    keys = ", ".join(f"v.{b.strip()}" for b in by.split(","))
    same = " AND ".join(f"v.{b.strip()} IS NOT DISTINCT FROM h.{b.strip()}" for b in by.split(","))
    names = ["lower_whisker", "lower_hinge", "middle", "upper_hinge", "upper_whisker"]
    return f"""WITH {source}, v AS (SELECT {by}, {value} AS x FROM {table} WHERE {value} IS NOT NULL),
  h AS (SELECT {by}, count(*) AS n, quantile_cont(x, 0.25) AS q1, median(x) AS q2, quantile_cont(x, 0.75) AS q3
    FROM v GROUP BY ALL),
  w AS (SELECT {keys}, any_value(n) AS n,
      min(CASE WHEN x >= q1 - 1.5::DOUBLE * (q3 - q1) AND x <= q3 + 1.5::DOUBLE * (q3 - q1) THEN x END) AS lower_whisker,
      any_value(q1) AS lower_hinge, any_value(q2) AS middle, any_value(q3) AS upper_hinge,
      max(CASE WHEN x >= q1 - 1.5::DOUBLE * (q3 - q1) AND x <= q3 + 1.5::DOUBLE * (q3 - q1) THEN x END) AS upper_whisker,
      count(*) FILTER (x < q1 - 1.5::DOUBLE * (q3 - q1) OR x > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers
    FROM v JOIN h ON {same} GROUP BY ALL)
  SELECT {by}, n, {", ".join(_r(c, digits, c) for c in names)}, n_outliers FROM w"""


_quints = " ".join(f"WHEN hb0900 <= q[{i + 2}] THEN '{label}'" for i, label in enumerate(QUINTILES))
ORACLE_SQL["asset_quintiles"] = _box(
    f"""{KNOWN}, q AS (SELECT quantile_cont(hb0900, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM known),
    classed AS (SELECT CASE {_quints} END AS quintile, di2000 FROM known, q)""",
    "classed", "quintile", "di2000", 7,
)
ORACLE_SQL["consumption_measures"] = f"""WITH {KNOWN} SELECT id, person_no, {_r("ln(docogood + 1)", 7, "log_consumption")},
  {_r("per_capita_consumption", 7, "per_capita_consumption")}, {_r("total_c", 7, "total_c")} FROM known"""
GROUPED = f"""{KNOWN}, grouped AS (SELECT *, CASE sa0100 WHEN 'AT' THEN 'Austria' ELSE 'Germany' END AS country,
    CASE change_category WHEN 'Increase 0-50%' THEN '0-50%' WHEN 'Increase 50-100%' THEN '50-100%' ELSE '>100%' END
      AS change_class
    FROM known WHERE change_category LIKE 'Increase%')"""
ORACLE_SQL["category_comparison"] = f"""WITH {GROUPED}
  SELECT country || ' ' || change_class AS "group", country, change_class, count(*) AS n,
    {_r("avg(per_capita_consumption)", 5, "mean_consumption")} FROM grouped GROUP BY ALL"""
SERIES = f"""{GROUPED}, two AS (SELECT id, person_no, country, change_class,
    per_capita_consumption AS "IV_model_1", per_capita_consumption AS "IV_model_2" FROM grouped),
  series AS (UNPIVOT two ON "IV_model_1", "IV_model_2" INTO NAME iv_model VALUE value)"""
ORACLE_SQL["unpivot_series"] = f"""WITH {SERIES}
  SELECT id, person_no, country, change_class, iv_model, {_r("value", 7, "value")} FROM series"""

# ---- correlation and regression --------------------------------------------------------------------------

SCOPES = "scopes AS (SELECT 'ALL' AS scope UNION ALL SELECT 'AT' UNION ALL SELECT 'DE')"
IN_SCOPE = "(scope = 'ALL' OR scope = sa0100)"


def _pair_rows() -> str:
    return " UNION ALL ".join(
        f"""SELECT scope, '{p}' AS pair, count(*) AS rows, regr_count({y}, {x})::BIGINT AS n,
      regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy
      FROM known JOIN scopes ON {IN_SCOPE} GROUP BY scope"""
        for p, (x, y) in PAIRS.items()
    )


ORACLE_SQL["corr_panel"] = f"""WITH {KNOWN}, {SCOPES}, m AS ({_pair_rows()})
  SELECT scope, pair, n, rows - n AS n_dropped,
    CASE WHEN pair IN ({_text(STRICT)}) AND scope = 'ALL' AND rows > n THEN NULL
      ELSE round(sxy / nullif(sqrt(sxx * syy), 0) + 1e-11::DOUBLE, 9) + 0.0 END AS r FROM m"""
# Two-sided t tail by the continued fraction of the incomplete beta function I_x(df/2, 1/2); where the
# fraction converges slowly the complement I_{1-x}(1/2, df/2) is taken.
def _tail(tests: str = "tests", half: str = "0.5", p: str = "") -> str:
    """CTEs up to `g`: the area beyond t (or beyond t * t = k F, with half = k / 2) of the rows (scope, pair, df, t) of `tests`."""
    return f"""{p}b AS (SELECT *, df / (df + t * t) AS x0 FROM {tests}),
  {p}s AS (SELECT *, x0 < (df / 2 + 1) / (df / 2 + {half}::DOUBLE + 2) AS direct FROM {p}b),
  {p}a AS (SELECT *, CASE WHEN direct THEN df / 2 ELSE {half}::DOUBLE END AS pa, CASE WHEN direct THEN {half}::DOUBLE ELSE df / 2 END AS pb,
      CASE WHEN direct THEN x0 ELSE t * t / (df + t * t) END AS x FROM {p}s),
  {p}f AS (SELECT scope, pair, 400 AS k, 1.0::DOUBLE AS v FROM {p}a
    UNION ALL SELECT {p}f.scope, {p}f.pair, k - 1, 1 + (CASE WHEN k % 2 = 0
        THEN (k // 2) * (pb - k // 2) * x / ((pa + k - 1) * (pa + k))
        ELSE -(pa + k // 2) * (pa + pb + k // 2) * x / ((pa + k - 1) * (pa + k)) END) / v
      FROM {p}f JOIN {p}a USING (scope, pair) WHERE k > 0),
  {p}g AS (SELECT {p}a.*, exp(lgamma(df / 2 + {half}::DOUBLE) - lgamma(df / 2) - lgamma({half}::DOUBLE)
      + pa * ln(x) + pb * ln(1 - x)) / pa / v AS area FROM {p}a JOIN {p}f USING (scope, pair) WHERE k = 0)"""


_TAIL = _tail()
ORACLE_SQL["corr_test_panel"] = f"""WITH RECURSIVE {KNOWN}, {SCOPES}, m AS ({_pair_rows()}),
  c AS MATERIALIZED (SELECT *, sxy / sqrt(sxx * syy) AS r, (n - 2)::DOUBLE AS df FROM m),
  tests AS MATERIALIZED (SELECT *, r * sqrt(df / (1 - r * r)) AS t FROM c), {_TAIL}
  SELECT scope, pair, n, {_r("r", 9, "r")}, df, {_r("t", 6, "t")},
    {_r("tanh(atanh(r) - 1.959963984540054::DOUBLE / sqrt(n - 3))", 9, "ci_low")},
    {_r("tanh(atanh(r) + 1.959963984540054::DOUBLE / sqrt(n - 3))", 9, "ci_high")},
    {_r("CASE WHEN direct THEN area ELSE 1 - area END", 6, "p")} FROM g"""


def _simple_fits(source: str, table: str, models: dict[str, tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT scope, '{name}' AS pair, regr_count({y}, {x})::BIGINT AS n, regr_avgx({y}, {x}) AS mx, regr_avgy({y}, {x}) AS my,
      regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy,
      regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2,
      min(CASE WHEN {y} IS NOT NULL THEN {x} END) AS min_x, max(CASE WHEN {y} IS NOT NULL THEN {x} END) AS max_x
      FROM {table} JOIN scopes ON {IN_SCOPE} GROUP BY scope"""
        for name, (x, y) in models.items()
    )
    return f"""{source}, {SCOPES}, m AS ({rows}),
  fits AS MATERIALIZED (SELECT *, (n - 2)::DOUBLE AS df, sqrt((syy - slope * sxy) / (n - 2)) AS sigma FROM m)"""


_WEALTH_MODELS = {"netliquidassets": ("netliquidassets", "change_absolute"), "networth": ("networth", "change_absolute")}
ORACLE_SQL["ols_simple"] = f"""WITH RECURSIVE {_simple_fits(TRIMMED, "trimmed", _WEALTH_MODELS)},
  tests AS MATERIALIZED (SELECT *, slope * sqrt(sxx) / sigma AS t FROM fits), {_TAIL}
  SELECT scope, pair AS model, n, df, {_r("intercept", 4, "intercept")}, {_r("slope", 8, "slope")},
    {_r("sigma * sqrt(1.0::DOUBLE / n + mx * mx / sxx)", 4, "se_intercept")}, {_r("sigma / sqrt(sxx)", 8, "se_slope")},
    {_r("intercept / (sigma * sqrt(1.0::DOUBLE / n + mx * mx / sxx))", 8, "t_intercept")}, {_r("t", 8, "t_slope")},
    {_r("sigma", 4, "sigma")}, {_r("r2", 8, "r2")}, {_r("CASE WHEN direct THEN area ELSE 1 - area END", 6, "p_slope")}
  FROM g"""
# 0.975 quantile of t by its expansion in 1/df around the normal quantile.
_Z = 1.959963984540054
_T975 = f"""({_Z!r}::DOUBLE + {(_Z**3 + _Z) / 4!r}::DOUBLE / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r}::DOUBLE / df**2
    + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r}::DOUBLE / df**3)"""


def _bands(source: str, table: str, models: dict[str, tuple[str, str]]) -> str:
    return f"""WITH {_simple_fits(source, table, models)},
  g AS (SELECT *, unnest(range(0, 80)) AS point FROM fits),
  x AS (SELECT *, min_x + point * (max_x - min_x) / 79 AS x FROM g),
  e AS (SELECT *, intercept + slope * x AS fit,
      {_T975} * sigma * sqrt(1.0::DOUBLE / n + (x - mx) ** 2 / sxx) AS half FROM x)
  SELECT scope, pair AS model, point::INTEGER AS point, {_r("x", 4, "x")}, {_r("fit", 4, "fit")},
    {_r("fit - half", 4, "low")}, {_r("fit + half", 4, "high")} FROM e"""


ORACLE_SQL["lm_band"] = _bands(TRIMMED, "trimmed", _WEALTH_MODELS)
ORACLE_SQL["lm_band_limited"] = _bands(
    f"""{KNOWN}, limited AS (SELECT *,
      CASE WHEN netliquidassets BETWEEN 0 AND 5000000 THEN netliquidassets END AS capped_assets FROM known)""",
    "limited",
    {
        "consumption": ("change_absolute", "di2000"),
        "savings": ("change_absolute", "netliquidassets"),
        "consumption_by_savings": ("capped_assets", "di2000"),
    },
)


def _swept(source: str, table: str, y: str, xs: list[str]) -> str:
    """CTEs that fit y on xs: the cross-product matrix, swept on one regressor after the other.

    The last, `fit`, has per scope the coefficients b0.., their unscaled variances v0.., and the residual and
    total sums of squares.
    """
    k = len(xs)
    cols = [*xs, y]
    listwise = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
    cells = ", ".join(
        f"sum(({cols[i]} - m{i}) * ({cols[j]} - m{j})) AS a_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)
    )
    keep = ", ".join(f"any_value(m{i}) AS m{i}" for i in range(k + 1))
    out = f"""{source}, {SCOPES}, d AS (SELECT scope, {", ".join(cols)} FROM {table} JOIN scopes ON {IN_SCOPE} WHERE {listwise}),
  mm AS (SELECT scope, count(*) AS n, {means} FROM d GROUP BY scope),
  s0 AS MATERIALIZED (SELECT scope, any_value(n) AS n, {keep}, {cells} FROM d JOIN mm USING (scope) GROUP BY scope)"""

    def a(i: int, j: int) -> str:
        return f"a_{min(i, j)}_{max(i, j)}"

    held = ", ".join(["scope", "n", *[f"m{i}" for i in range(k + 1)]])
    # Sweep in the symmetric form: pivot p -> -1/app, column -> a/app, rest -> a_ij - a_ip a_pj / app.
    for p in range(k):
        exprs = []
        for i in range(k + 1):
            for j in range(i, k + 1):
                if i == p and j == p:
                    e = f"-1 / {a(p, p)}"
                elif p in (i, j):
                    e = f"{a(i, j)} / {a(p, p)}"
                else:
                    e = f"{a(i, j)} - {a(i, p)} * {a(p, j)} / {a(p, p)}"
                exprs.append(f"{e} AS a_{i}_{j}")
        out += f",\n  s{p + 1} AS MATERIALIZED (SELECT {held}, {', '.join(exprs)} FROM s{p})"
    slopes = ", ".join(f"f.a_{i}_{k} AS b{i + 1}, -f.{a(i, i)} AS v{i + 1}" for i in range(k))
    at_means = " + ".join(f"f.m{i} * f.a_{i}_{k}" for i in range(k))
    quad = " - ".join(f"f.m{i} * f.m{j} * f.{a(i, j)}" for i in range(k) for j in range(k))
    return f"""{out},
  fit AS MATERIALIZED (SELECT f.scope, f.n, f.n - {k + 1} AS df, f.a_{k}_{k} AS rss, t.a_{k}_{k} AS tss,
    f.m{k} - ({at_means}) AS b0, 1.0::DOUBLE / f.n - {quad} AS v0, {slopes} FROM s{k} f JOIN s0 t USING (scope))"""


def _coef_table(source: str, y: str, xs: list[str], table: str = "fam2") -> str:
    k = len(xs)
    terms = " UNION ALL ".join(
        f"SELECT *, '{t}' AS term, b{i} AS b, sqrt(rss / df * v{i}) AS se FROM fit"
        for i, t in enumerate(["(Intercept)", *xs])
    )
    return f"""WITH RECURSIVE {_swept(source, table, y, xs)},
  stats AS (SELECT *, sqrt(rss / df) AS sigma, 1 - rss / tss AS r2, (tss - rss) / {k} / (rss / df) AS f FROM ({terms})),
  tests0 AS MATERIALIZED (SELECT scope, term AS pair, n, df::DOUBLE AS df, b / se AS t, b, se, sigma, r2, f FROM stats),
  tests AS (SELECT * FROM tests0), {_TAIL},
  joint AS MATERIALIZED (SELECT DISTINCT scope, 'f' AS pair, df, sqrt({k} * f) AS t FROM tests0), {_tail("joint", repr(k / 2), "j")},
  joined AS (SELECT g.*, CASE WHEN jg.direct THEN jg.area ELSE 1 - jg.area END AS f_p FROM g JOIN jg USING (scope))
  SELECT scope, pair AS term, {_r("b", 7, "estimate")}, {_r("se", 7, "std_error")}, {_r("t", 6, "t")},
    {_r("CASE WHEN direct THEN area ELSE 1 - area END", 6, "p")}, n, df::BIGINT AS df, {_r("sigma", 4, "sigma")},
    {_r("r2", 9, "r2")}, {_r("1 - (1 - r2) * (n - 1) / df", 9, "adj_r2")}, {_r("f", 3, "f")}, {_r("f_p", 6, "f_p")} FROM joined"""


FAMILY2 = f"{FAMILY}, fam2 AS (SELECT *, {_FAMSTRUCT} AS famstruct FROM fam)"
ORACLE_SQL["ols_two_regressors"] = _coef_table(FAMILY2, "di2000", ["change_absolute", "age"])
ORACLE_SQL["ols_aliased"] = f"""WITH fitted AS ({ORACLE_SQL["ols_two_regressors"]})
  SELECT * FROM fitted UNION ALL
  SELECT scope, 'both', NULL, NULL, NULL, NULL, n, df, sigma, r2, adj_r2, f, f_p FROM fitted WHERE term = 'age'"""
ORACLE_SQL["ols_consumption"] = _coef_table(FAMILY2, "di2000", ["change_absolute", *CONTROLS])
ORACLE_SQL["ols_savings"] = _coef_table(FAMILY2, "netliquidassets", ["change_absolute", *CONTROLS])
ORACLE_SQL["ols_consumption_savings"] = _coef_table(FAMILY2, "di2000", ["netliquidassets", *CONTROLS])


def _residual_table(y: str, xs: list[str]) -> str:
    fitted = " + ".join(["b0", *[f"b{i} * {x}" for i, x in enumerate(xs, 1)]])
    return f"""WITH {_swept(FAMILY2, "fam2", y, xs)},
  e AS (SELECT scope, {y} - ({fitted}) AS e FROM fit JOIN fam2 ON {IN_SCOPE})
  SELECT scope, {_r("min(e)", 5, "min_residual")}, {_r("quantile_cont(e, 0.25)", 5, "p25_residual")},
    {_r("median(e)", 5, "median_residual")}, {_r("quantile_cont(e, 0.75)", 5, "p75_residual")},
    {_r("max(e)", 5, "max_residual")} FROM e GROUP BY scope"""


ORACLE_SQL["ols_residuals"] = _residual_table("di2000", ["change_absolute", "age"])
ORACLE_SQL["ols_residuals_consumption"] = _residual_table("di2000", ["change_absolute", *CONTROLS])
ORACLE_SQL["ols_residuals_savings"] = _residual_table("netliquidassets", ["change_absolute", *CONTROLS])
ORACLE_SQL["ols_residuals_consumption_savings"] = _residual_table("di2000", ["netliquidassets", *CONTROLS])
ORACLE_SQL["residuals_liquid_assets"] = _residual_table("netliquidassets", ["change_absolute"])
ORACLE_SQL["residuals_networth"] = _residual_table("networth", ["change_absolute"])


def _iv(x: str, z: str) -> str:
    y = "per_capita_consumption"
    return f"""WITH RECURSIVE {KNOWN}, {SCOPES},
  d AS (SELECT scope, {y} AS y, {x} AS x, {z} AS z FROM known JOIN scopes ON {IN_SCOPE}
    WHERE {y} IS NOT NULL AND {x} IS NOT NULL AND {z} IS NOT NULL),
  m AS (SELECT scope, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(z, y) / covar_pop(z, x) AS b,
      var_pop(x) * count(*) AS sxx, covar_pop(x, z) * count(*) AS sxz, var_pop(z) * count(*) AS szz,
      var_pop(y) * count(*) AS syy FROM d GROUP BY scope),
  e AS (SELECT d.scope, sum((y - my - b * (x - mx)) ** 2) AS rss FROM d JOIN m USING (scope) GROUP BY d.scope),
  o AS (SELECT *, sxz * sxz / szz AS fitted, rss / (n - 2) AS s2 FROM m JOIN e USING (scope)),
  terms AS (SELECT *, '(Intercept)' AS term, my - b * mx AS est, sqrt(s2 * (1.0::DOUBLE / n + mx * mx / fitted)) AS se FROM o
    UNION ALL SELECT *, '{x}', b, sqrt(s2 / fitted) FROM o),
  tests AS MATERIALIZED (SELECT scope, term AS pair, n, (n - 2)::DOUBLE AS df, est / se AS t, est, se, sqrt(s2) AS sigma,
    1 - rss / syy AS r2, b * b * fitted / s2 AS f FROM terms), {_TAIL},
  joint AS MATERIALIZED (SELECT DISTINCT scope, 'f' AS pair, df, sqrt(f) AS t FROM tests), {_tail("joint", "0.5", "j")},
  joined AS (SELECT g.*, CASE WHEN jg.direct THEN jg.area ELSE 1 - jg.area END AS f_p FROM g JOIN jg USING (scope))
  SELECT scope, pair AS term, {_r("est", 3, "estimate")}, {_r("se", 1, "std_error")}, {_r("t", 6, "t")},
    {_r("CASE WHEN direct THEN area ELSE 1 - area END", 6, "p")}, n, df::BIGINT AS df, {_r("sigma", 3, "sigma")},
    {_r("r2", 6, "r2")}, {_r("1 - (1 - r2) * (n - 1) / df", 6, "adj_r2")}, {_r("f", 6, "f")}, {_r("f_p", 6, "f_p")} FROM joined"""


ORACLE_SQL["iv_consumption_price"] = _iv("hb0900", "hb0800")
ORACLE_SQL["iv_consumption_share"] = _iv("docogood", "docogoodp")

# ---- chart data ------------------------------------------------------------------------------------------

_measures = {
    "mean_change_absolute": "avg(change_absolute)",
    "median_change_absolute": "median(change_absolute)",
    "median_change_per_sqm": "median(change_per_sqm)",
    "mean_networth": "avg(networth)",
    "median_networth": "median(networth)",
    "mean_netliquidassets": "avg(netliquidassets)",
    "median_netliquidassets": "median(netliquidassets)",
}
ORACLE_SQL["box_stats_by_age"] = _box(
    f"""{PROFILED}, pr AS (SELECT sa0100, region, age_group, {", ".join(f"{e} AS {n}" for n, e in _measures.items())}
      FROM profiled GROUP BY ALL),
    long AS (UNPIVOT pr ON {", ".join(_measures)} INTO NAME measure VALUE value)""",
    "long", "sa0100, measure, age_group", "value", 5,
)
ORACLE_SQL["box_stats_behaviour"] = _box(
    f"""{FLAGGED}, long AS (SELECT sa0100, significant_increase, 'consumption' AS measure, di2000 AS value FROM flagged
      UNION ALL SELECT sa0100, significant_increase, 'savings', netliquidassets FROM flagged
      WHERE netliquidassets BETWEEN 0 AND 1000000)""",
    "long", "measure, significant_increase, sa0100", "value", 7,
)
ORACLE_SQL["box_stats_panel"] = _box(SERIES, "series", "country, iv_model, change_class", "value", 7)
ORACLE_SQL["box_stats_group"] = _box(
    f"""{GROUPED}, heads AS (SELECT country || ' ' || change_class AS grp, total_c / nullif(dh0001, 0) AS x FROM grouped)""",
    "(SELECT grp, x AS per_head FROM heads WHERE x >= 0)", "grp", "per_head", 7,
).replace("SELECT grp, n,", 'SELECT grp AS "group", n,')


def _kde(column: str, digits: int) -> str:
    kernel = "exp(-0.5::DOUBLE * ((x0 + point * step - (x0 + node * width)) / h) ** 2)"
    return f"""WITH {KNOWN}, v AS (SELECT sa0100, {column} AS x FROM known WHERE {column} IS NOT NULL),
  s AS (SELECT sa0100, count(*) AS n, min(x) AS x0, (max(x) - min(x)) / 1024 AS width, (max(x) - min(x)) / 511 AS step,
      0.9::DOUBLE * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::DOUBLE)
        * pow(count(*), -0.2::DOUBLE) AS h FROM v GROUP BY sa0100),
  p AS (SELECT sa0100, (x - x0) / width AS pos, least(floor((x - x0) / width), 1023) AS cell FROM v JOIN s USING (sa0100)),
  c AS (SELECT sa0100, cell AS node, sum(1 - (pos - cell)) AS mass FROM p GROUP BY ALL
    UNION ALL SELECT sa0100, cell + 1, sum(pos - cell) FROM p GROUP BY ALL),
  k AS (SELECT sa0100, node, sum(mass) AS mass FROM c GROUP BY ALL),
  g AS (SELECT *, unnest(range(0, 512)) AS point FROM s)
  SELECT sa0100, point::INTEGER AS point, {_r("any_value(x0 + point * step)", 5, "x")}, {_r("any_value(h)", 6, "bandwidth")},
    {_r(f"sum(mass * {kernel}) / (2.5066282746310002::DOUBLE * any_value(h) * any_value(n))", digits, "density")}
  FROM g JOIN k USING (sa0100) GROUP BY sa0100, point"""


ORACLE_SQL["kde_networth"] = _kde("networth", 14)
ORACLE_SQL["kde_liquid_assets"] = _kde("netliquidassets", 13)
ORACLE_SQL["bin2d_change_assets"] = f"""WITH {KNOWN}, b AS (SELECT sa0100, floor(change_absolute / 5000)::BIGINT AS bin_x,
    floor(netliquidassets / 500)::BIGINT AS bin_y FROM known)
  SELECT sa0100, bin_x, bin_y, count(*) AS n, {_r("(bin_x + 0.5::DOUBLE) * 5000", 4, "x")},
    {_r("(bin_y + 0.5::DOUBLE) * 500", 4, "y")} FROM b WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY ALL"""

# Rows of a country, levels of its rectangles, and the number above which a rectangle is divided.
ORACLE_SQL["bin2d_bounded"] = f"""WITH {KNOWN}, fine AS (SELECT sa0100, floor(change_absolute / 500)::BIGINT AS bx,
    floor(netliquidassets / 50)::BIGINT AS by_, count(*) AS n FROM known
    WHERE change_absolute IS NOT NULL AND netliquidassets IS NOT NULL GROUP BY ALL),
  g AS (SELECT sa0100, count(*) AS cells, sum(n) AS total,
    floor(log2(greatest(1, max(greatest(bx, -bx - 1, by_, -by_ - 1)))))::INTEGER + 1 AS bits FROM fine GROUP BY sa0100),
  h AS (SELECT sa0100, CASE WHEN cells > 400 THEN bits ELSE 0 END AS height,
    CASE WHEN cells > 400 THEN total * 4.0::DOUBLE * (bits + 1) / 396 ELSE -1 END AS least FROM g),
  e AS (SELECT f.*, least, height, unnest(range(0, height + 1)) AS level FROM fine f JOIN h USING (sa0100)),
  c AS (SELECT sa0100, level, floor(bx / 2 ** level)::BIGINT AS bx, floor(by_ / 2 ** level)::BIGINT AS by_, sum(n) AS n,
    any_value(least) AS least, any_value(height) AS height FROM e GROUP BY 1, 2, 3, 4),
  o AS (SELECT c.* FROM c LEFT JOIN c p ON p.sa0100 = c.sa0100 AND p.level = c.level + 1 AND p.bx = floor(c.bx / 2.0::DOUBLE)
      AND p.by_ = floor(c.by_ / 2.0::DOUBLE)
    WHERE (c.n <= c.least OR c.level = 0) AND (c.level = c.height OR p.n > p.least))
  SELECT sa0100, level::INTEGER AS level, bx AS bin_x, by_ AS bin_y, n::BIGINT AS n,
    {_r("(bx + 0.5::DOUBLE) * 500 * 2 ** level", 4, "x")}, {_r("(by_ + 0.5::DOUBLE) * 50 * 2 ** level", 4, "y")} FROM o"""
