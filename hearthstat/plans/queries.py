"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables.

Floating-point results are rounded, because the order of summation is free.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthstat.functions.expr import cut, first_match, quoted, ratio, recode
from hearthstat.operators import layers, models, prep, summary, survey
from hearthstat.operators.quantiles import describe_by
from hearthstat.plans import analysis, variables as v
from hearthstat.sources.house import COUNTRIES, REPLICATES, house, replicate_vectors, table
from hearthstat.sources.stored import store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

CHANGE = ["sa0100", "hb0800", "hb0900"]
CONSUMPTION = ["docogood", "dofoodc", "hi0210", "dh0001"]


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int | Mapping[str, int], default: int | None = None) -> DataFrame:
    """Round the double columns, all to `digits` or by a map of name prefixes.

    A hundredth of the last digit is added first: exact decimal halves, such as means of prices, then
    round the same way whatever the last bit of the sum.
    """

    def places(name: str) -> int | None:
        if isinstance(digits, int):
            return digits
        return next((d for prefix, d in digits.items() if name.startswith(prefix)), default)

    out = []
    for name, kind in df.dtypes:
        d = places(name) if kind == "double" else None
        out.append(quoted(name) if d is None else f"round({quoted(name)} + 1e-{d + 2}D, {d}) AS {quoted(name)}")
    return df.selectExpr(*out)


# Quantiles are order statistics and agree to the last digits; moments carry summation noise.
STAT_DIGITS = {"p": 8, "median": 8, "min": 8, "max": 8, "mean": 4, "sd": 4, "var": 0}


def known_change(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    return v.with_known_change(house(spark, sf_dir, list(dict.fromkeys([*CHANGE, *cols]))))


def stored_known_change(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    """The same, stored: for queries that read it several times."""
    return store(known_change(spark, sf_dir, cols).drop("hb0800"))


# ---- survey tables ---------------------------------------------------------------------------------

DESIGN = survey.Design(weight="hw0010", implicate="im0100")


@register
def weighted_distribution(spark, sf_dir):
    """Weighted distribution of the price change by country, averaged over the implicates."""
    df = v.with_changes(house(spark, sf_dir, [*CHANGE, "im0100", "hw0010"]))
    levels = {"change_category": v.CHANGE_LEVELS, "sa0100": COUNTRIES}
    mean = survey.implicate_mean(df, levels, DESIGN)
    return rounded(survey.share(mean, "weighted_count", ["sa0100"]), {"weighted": 6, "prop": 10})


@register
def weighted_distribution_by_year(spark, sf_dir):
    """The same within country and period of acquisition; also the segments of a filled bar chart."""
    df = v.with_changes(house(spark, sf_dir, [*CHANGE, "hb0700", "im0100", "hw0010"]))
    df = df.withColumn("year_acquisition_category", v.acquisition_period())
    levels = {
        "change_category": v.CHANGE_LEVELS,
        "year_acquisition_category": v.YEAR_LEVELS,
        "sa0100": COUNTRIES,
    }
    mean = survey.implicate_mean(df, levels, DESIGN)
    out = survey.share(mean, "weighted_count", ["sa0100", "year_acquisition_category"])
    return rounded(out, {"weighted": 6, "prop": 10})


@register
def weighted_table_by_implicate(spark, sf_dir):
    df = v.with_changes(house(spark, sf_dir, [*CHANGE, "im0100", "hw0010"]))
    levels = {"change_category": v.CHANGE_LEVELS, "sa0100": COUNTRIES}
    return rounded(survey.weighted_table(df, levels, DESIGN), 6)


@register
def simple_design_table(spark, sf_dir):
    """Weighted table of a design without implicates."""
    df = v.with_changes(house(spark, sf_dir, [*CHANGE, "hw0010"]))
    levels = {"change_category": v.CHANGE_LEVELS, "sa0100": COUNTRIES}
    return rounded(survey.weighted_table(df, levels, survey.Design(weight="hw0010")), 6)


@register
def weighted_distribution_missing_implicates(spark, sf_dir):
    """The distribution where the implicate of some records is not known: they belong to none."""
    df = v.with_changes(house(spark, sf_dir, ["id", *CHANGE, "im0100", "hw0010"]))
    df = df.withColumn("im0100", F.when(F.col("id") % 23 != 0, F.col("im0100")))
    levels = {"change_category": v.CHANGE_LEVELS, "sa0100": COUNTRIES}
    mean = survey.implicate_mean(df, levels, DESIGN)
    return rounded(survey.share(mean, "weighted_count", ["sa0100"]), {"weighted": 6, "prop": 10})


@register
def replicate_variance_share(spark, sf_dir):
    """Totals and shares per cell with their replicate-weight variances."""
    df = v.with_changes(house(spark, sf_dir, ["id", *CHANGE, "im0100", "hw0010"]))
    design = survey.Design(weight="hw0010", implicate="im0100", combined=False)
    levels = {"change_category": v.CHANGE_LEVELS, "sa0100": COUNTRIES}
    vectors = replicate_vectors(spark, sf_dir, REPLICATES)
    out = survey.household_replicate_variance(df, vectors, ["id"], levels, design, ["sa0100"], missing_keys=False)
    return rounded(out, {"total": 6, "var_total": 4, "share": 10, "var_share": 12})


PIPELINE_REPLICATES = 10


def survey_tables(spark, sf_dir):
    """Person, household (D, H) and weight tables with mixed spellings: a line item is a household's record in an implicate."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")

    def keys(key: str) -> list[str]:
        country = f"CASE {key} % 3 WHEN 0 THEN 'AT' WHEN 1 THEN 'DE' ELSE 'FR' END"
        return ["3 AS survey", f"{key} AS Sa0010", f"{country} AS sa0100"]

    record = [*keys("l_orderkey"), "l_linenumber AS im0100"]
    d = lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS ID", *record, "l_quantity AS hw0010", "18D + l_partkey % 70 AS DHAGEH1B",
        "18D + l_partkey % 68 AS DHAGEH1", "int(l_partkey % 5) AS DHEDUH1", "'AT11' AS DHREGION", "double(l_linenumber) AS DH0001",
        "2D AS dh0006", "l_extendedprice AS DI2000", "l_quantity AS DNNLA", "l_extendedprice AS DN3001",
        *[f"l_tax * {i} AS {n}" for i, n in enumerate(INCOMES, 1)],
    )
    h = lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", *record, "CASE WHEN l_suppkey % 29 = 0 THEN l_quantity + 1 ELSE l_quantity END AS HW0010",
        "CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity * 1000 END AS HB0800",
        "CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice * (1 + l_suppkey % 3) / 2 END AS hb0900",
        "int(1960 + l_partkey % 60) AS HB0700", "60D AS HB0100", "l_extendedprice AS docogood", "l_tax AS DOFOODC", "l_discount AS HI0210",
    )
    p = lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS HID", *record, "explode(array(1, 2)) AS RA0100", "int(1 + l_partkey % 2) AS RA0200",
        "int(1 + l_partkey % 5) AS PA0100", "int(l_suppkey % 7) AS PA0200", "int(1 + l_linenumber % 3) AS PE0100A",
    ).selectExpr("HID * 10 + RA0100 AS ID", "*")
    factors = [
        f"CASE WHEN o_custkey % 7 <> 0 OR {r} % 2 = 1 THEN 10D * (1 + (o_orderkey * {r} + o_custkey) % 3) END AS wr{r:04d}"
        for r in range(1, PIPELINE_REPLICATES + 1)
    ]
    w = orders.selectExpr(*keys("o_orderkey"), *factors)
    return p, d, h, w


@register
def survey_pipeline(spark, sf_dir):
    """The whole way: input tables, household table, replicate weights, distribution of the price change and its variance."""
    p, d, h, w = survey_tables(spark, sf_dir)
    households = analysis.household_table(p, d, h)
    weights = analysis.weight_table(w)
    names = prep.columns_between(weights, "WR0001", f"WR{PIPELINE_REPLICATES:04d}")
    keys = ["SURVEY", "SA0010", "SA0100"]
    design = survey.Design(weight="HW0010", implicate="IM0100")
    levels = {"change_category": v.CHANGE_LEVELS, "SA0100": COUNTRIES}
    vectors = survey.replicate_vectors(weights, keys, names)
    out = survey.household_replicate_variance(households, vectors, keys, levels, design, ["SA0100"])
    return rounded(out, {"total": 6, "var_total": 4, "share": 10, "var_share": 12})


# ---- summaries -------------------------------------------------------------------------------------


@register
def change_summary(spark, sf_dir):
    stats = ["mean", "median", "sd"]
    df = known_change(spark, sf_dir, [])
    return rounded(
        describe_by(df, ["sa0100"], {"change_ratio": stats, "change_absolute": stats}, count="n"),
        STAT_DIGITS,
    )


@register
def wealth_summary(spark, sf_dir):
    stats = ["mean", "median", "sd", "var", 0.1, 0.25, 0.5, 0.75, 0.9]
    df = known_change(spark, sf_dir, ["netliquidassets", "networth"])
    return rounded(
        describe_by(df, ["sa0100"], {"netliquidassets": stats, "networth": stats}, count="n"), STAT_DIGITS
    )


@register
def refperson_summary(spark, sf_dir):
    stats = ["mean", "median", "sd"]
    df = known_change(spark, sf_dir, ["agerefperson", "edurefperson"])
    return rounded(
        describe_by(df, ["sa0100"], {"agerefperson": stats, "edurefperson": stats}, count="n"), 8
    )


WEIGHTED_STATS = {c: ["mean", "median", "sd", "var", 0.1, 0.25, 0.75, 0.9] for c in ("change_absolute", "netliquidassets", "networth")}


@register
def weighted_wealth_by_implicate(spark, sf_dir):
    """Weighted mean, spread and quantiles of wealth and of the price change, per country and implicate."""
    df = known_change(spark, sf_dir, ["netliquidassets", "networth", "im0100", "hw0010"])
    return rounded(describe_by(df, ["sa0100", "im0100"], WEIGHTED_STATS, count="n", weight="hw0010"), STAT_DIGITS)


@register
def weighted_wealth_summary(spark, sf_dir):
    """The same per country, averaged over the implicates; some records have no weight."""
    df = known_change(spark, sf_dir, ["id", "netliquidassets", "networth", "im0100", "hw0010"])
    df = df.withColumn("hw0010", F.when(F.col("id") % 29 != 0, F.col("hw0010")))
    out = describe_by(df, ["sa0100"], WEIGHTED_STATS, count="n", weight="hw0010", by_implicate="im0100")
    return rounded(out, STAT_DIGITS | {"n": 6})


@register
def wealth_summary_by_implicate(spark, sf_dir):
    """Unweighted statistics of each implicate, averaged over the implicates."""
    df = known_change(spark, sf_dir, ["netliquidassets", "networth", "im0100"])
    stats = ["mean", "median", "sd", 0.1, 0.9]
    return rounded(describe_by(df, ["sa0100"], {"netliquidassets": stats, "networth": stats}, count="n", by_implicate="im0100"), STAT_DIGITS | {"n": 6})


PROFILE = {
    "change_absolute": ["mean", "median", "sd", "var"],
    "agerefperson": ["mean", "median"],
    "edurefperson": ["mean", "median"],
    "netliquidassets": ["mean", "median"],
    "networth": ["mean", "median"],
    "hb0100": ["mean", "median"],
    "change_per_sqm": ["mean", "median"],
}
PROFILE_COLUMNS = ["dhregion", "agerefperson", "edurefperson", "netliquidassets", "networth", "hb0100"]


def _profile(spark, sf_dir, by):
    df = known_change(spark, sf_dir, PROFILE_COLUMNS).withColumns(
        {
            "region": recode("dhregion", v.REGION_NAMES),
            "age_group": cut("agerefperson", v.AGE_BREAKS, v.AGE_LEVELS),
            "change_per_sqm": ratio("change_absolute", "hb0100"),
        }
    )
    return describe_by(df, by, PROFILE)


@register
def region_profile(spark, sf_dir):
    return rounded(_profile(spark, sf_dir, ["sa0100", "region"]), STAT_DIGITS)


@register
def region_age_profile(spark, sf_dir):
    return rounded(_profile(spark, sf_dir, ["sa0100", "region", "age_group"]), STAT_DIGITS)


@register
def extreme_profiles(spark, sf_dir):
    """Region and age group with the largest and the smallest mean and median change, per country."""
    measures = ["mean_change_absolute", "median_change_absolute"]
    profile = _profile(spark, sf_dir, ["sa0100", "region", "age_group"])
    profile = profile.select("sa0100", "region", "age_group", *measures)
    return rounded(summary.extreme_profile(profile, measures, ["sa0100"]), 4)


@register
def behaviour_summary(spark, sf_dir):
    """Consumption and savings by significant increase and country."""
    stats = ["mean", "median", "sd"]
    df = known_change(spark, sf_dir, [*CONSUMPTION, "da2101"])
    df = v.with_consumption(df).withColumn("significant_increase", v.significant_increase())
    out = describe_by(df, ["significant_increase", "sa0100"], {"total_c": stats, "da2101": stats}, count="n")
    return rounded(out, STAT_DIGITS)


INCOMES = ["di1100", "di1200", "di1300", "di1400", "di1420", "di1500", "di1600", "di1700"]


@register
def mpc_by_status(spark, sf_dir):
    """Share of income consumed, for hand-to-mouth households and others."""
    df = v.with_incomes(known_change(spark, sf_dir, ["netliquidassets", "di2000", *INCOMES]))
    df = df.withColumns({"htm_status": v.hand_to_mouth(), "mpc": ratio("di2000", "total_gross_income")})
    return rounded(describe_by(df, ["htm_status"], {"mpc": ["median", "mean"]}), {"median": 8, "mean": 6})


@register
def null_profile(spark, sf_dir):
    df = house(spark, sf_dir, [*CHANGE, "hb0700", "da2101"])
    return rounded(summary.null_profile(df, ["hb0800", "hb0900", "hb0700", "da2101"], ["sa0100"]), 10)


@register
def six_number_summary(spark, sf_dir):
    df = v.with_incomes(house(spark, sf_dir, ["di2000", *INCOMES], countries=None))
    out = summary.six_numbers(df, ["income", "income_psid", "total_gross_income", "di2000"])
    return rounded(out, {"mean": 4}, default=7)


@register
def value_ranges(spark, sf_dir):
    df = known_change(spark, sf_dir, ["hb0700"])
    return summary.value_range(df, "hb0700", ["sa0100"])


@register
def crosstab_counts(spark, sf_dir):
    df = v.with_changes(house(spark, sf_dir, CHANGE))
    return summary.crosstab(df, {"sa0100": COUNTRIES, "change_category": v.CHANGE_LEVELS})


@register
def acquisition_counts(spark, sf_dir):
    df = known_change(spark, sf_dir, ["hb0700"]).withColumn("period", v.acquisition_period())
    return summary.frequency(df, "period", v.YEAR_LEVELS)


# ---- preparation -----------------------------------------------------------------------------------

# One input file per implicate, each with its own spelling of the same columns.
PARTS = [
    ("customer", "c_custkey", "c_acctbal", ("Id", "Value")),
    ("supplier", "s_suppkey", "s_acctbal", ("ID", "value")),
    ("part", "p_partkey", "p_retailprice", ("id", "VALUE")),
    ("orders", "o_orderkey", "o_totalprice", ("iD", "Value")),
    ("lineitem", "l_orderkey", "l_extendedprice", ("ID", "VALUE")),
]


@register
def stack_implicates(spark, sf_dir):
    """Five tables with differently spelled columns as one table."""
    parts = [
        prep.upper_names(
            table(spark, sf_dir, name).select(
                F.col(key).alias(spelling[0]), F.lit(i).alias("im0100"), F.col(value).alias(spelling[1])
            )
        )
        for i, (name, key, value, spelling) in enumerate(PARTS, start=1)
    ]
    return prep.stack(parts)


def household_tables(spark, sf_dir):
    """Household tables D and H and the person table, with missing values among the keys."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def keys(key: str):
        k = F.col(key)
        return {
            "SURVEY": F.lit(3),
            "SA0010": F.when(k % 17 != 0, k + 1000),
            "SA0100": F.when(k % 2 == 0, "AT").otherwise("DE"),
            "IM0100": 1 + k % 5,
        }

    def cols(exprs):
        return [e.alias(n) for n, e in exprs.items()]

    d = orders.select(
        F.col("o_orderkey").alias("ID"), *cols(keys("o_orderkey")),
        F.when(F.col("o_orderkey") % 19 != 0, F.col("o_totalprice") / 4).alias("HW0010"),
        F.col("o_totalprice").alias("DN3001"),
    )
    # Some rows of H miss a key that D has, so that not every household of D finds its row.
    lost = {"SA0010": F.when(F.col("o_orderstatus") != "P", keys("o_orderkey")["SA0010"])}
    h = orders.select(
        F.col("o_orderkey").alias("ID"), *cols(keys("o_orderkey") | lost),
        F.when(F.col("o_orderkey") % 19 != 0, F.col("o_totalprice") / 4).alias("HW0010"),
        F.year("o_orderdate").alias("HB0700"),
    )
    p = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ID"),
        F.col("l_orderkey").alias("HID"), *cols(keys("l_orderkey")),
        F.col("l_linenumber").alias("RA0100"), F.col("l_quantity").alias("PA0200"),
    )
    return d, h, p


@register
def attach_reference_person(spark, sf_dir):
    """Household tables joined on six keys, then the reference person of each household."""
    d, h, p = household_tables(spark, sf_dir)
    merged = prep.merge_households(d, h)
    return prep.attach_reference(merged, p).select(
        "ID", "IM0100", "SA0010", "DN3001", "HB0700", "PERSON_ID", "PA0200"
    )


@register
def income_aggregates(spark, sf_dir):
    df = v.with_incomes(house(spark, sf_dir, ["id", "person_no", *INCOMES], countries=None))
    return rounded(df.select("id", "person_no", "income", "income_psid", "total_gross_income"), 6)


PERSON = ["age", "ra0200", "pa0100", "pa0200", "pe0100a", "dh0001", "dh0006"]


@register
def person_indicators(spark, sf_dir):
    df = v.with_person_variables(house(spark, sf_dir, PERSON, countries=None))
    return layers.bar_counts(df, ["female", "edcat", "working", "married", "college"])


@register
def age_bands(spark, sf_dir):
    df = v.with_person_variables(house(spark, sf_dir, PERSON, countries=None))
    return layers.bar_counts(df, ["age", "agedum"])


@register
def family_structure(spark, sf_dir):
    df = v.with_family(house(spark, sf_dir, ["age", "pa0100", "dh0001", "dh0006"], countries=None))
    return layers.bar_counts(df, ["married", "children", "famstruct", "family"])


@register
def residence_age_counts(spark, sf_dir):
    """Years since the acquisition of the residence, 0 where the year is unknown."""
    df = known_change(spark, sf_dir, ["hb0700"]).select("sa0100", v.residence_age().alias("age_main_residence"))
    return layers.bar_counts(df, ["sa0100", "age_main_residence"])


@register
def region_recode(spark, sf_dir):
    df = house(spark, sf_dir, ["dhregion"]).withColumn("region", recode("dhregion", v.REGION_NAMES))
    return layers.bar_counts(df, ["dhregion", "region"])


@register
def trim_top1(spark, sf_dir):
    """Records at or below the 99th percentile of each of three columns."""
    cols = ["netliquidassets", "networth", "change_absolute"]
    return _trimmed(spark, sf_dir, ["id", "person_no", "sa0100", *cols])


def _trimmed(spark, sf_dir, cols):
    df = store(known_change(spark, sf_dir, ["id", "person_no", "netliquidassets", "networth"]).select(*cols))
    limits = {"netliquidassets": 0.99, "networth": 0.99, "change_absolute": 0.99}
    return prep.trim_quantiles(df, upper=limits, stored=True)


@register
def trim_5_95(spark, sf_dir):
    df = store(known_change(spark, sf_dir, ["id", "person_no", "di2000"]).select("id", "person_no", "di2000"))
    return rounded(prep.trim_quantiles(df, {"di2000": 0.95}, {"di2000": 0.05}, stored=True), 6)


@register
def asset_quintiles(spark, sf_dir):
    """Distribution of income within the quintiles of the residence value."""
    df = store(known_change(spark, sf_dir, ["di2000"]).select("hb0900", "di2000"))
    df = prep.quantile_class(df, "hb0900", v.QUINTILES, "quintile", stored=True)
    return rounded(layers.box_stats(df, ["quintile"], "di2000", stored=True), 7)


@register
def consumption_measures(spark, sf_dir):
    df = v.with_consumption(known_change(spark, sf_dir, ["id", "person_no", *CONSUMPTION]))
    cols = ["log_consumption", "per_capita_consumption", "total_c"]
    return rounded(df.select("id", "person_no", *cols), 7)


def _groups(df):
    """The six compared groups with their country and class, from a table with the price change."""
    return prep.tag_subsets(v.with_consumption(df), v.comparison_groups()).withColumns(
        {
            "country": first_match("group", [("Austria", "Austria")], "Germany"),
            "change_class": first_match("group", [(c, c) for c in v.GROUP_CLASSES]),
        }
    )


@register
def category_comparison(spark, sf_dir):
    """Records and mean consumption per head in the six compared groups."""
    df = _groups(stored_known_change(spark, sf_dir, CONSUMPTION))
    out = df.groupBy("group", "country", "change_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("per_capita_consumption").alias("mean_consumption")
    )
    return rounded(out, 5)


def _series(df, ids):
    same = F.col("per_capita_consumption")
    df = _groups(df).withColumns({"IV_model_1": same, "IV_model_2": same})
    df = df.select(*ids, "country", "change_class", "IV_model_1", "IV_model_2")
    return prep.to_long(df, ["IV_model_1", "IV_model_2"], "iv_model", "value")


@register
def unpivot_series(spark, sf_dir):
    df = stored_known_change(spark, sf_dir, ["id", "person_no", *CONSUMPTION])
    return rounded(_series(df, ["id", "person_no"]), 7)


# ---- correlation and regression ----------------------------------------------------------------------

PAIRS = {
    f"{x}*{y}": (x, y)
    for x, y in [
        ("change_absolute", "netliquidassets"),
        ("change_ratio", "netliquidassets"),
        ("change_absolute", "networth"),
        ("change_ratio", "networth"),
        ("change_absolute", "hb0100"),
        ("change_absolute", "age_main_residence"),
        ("change_ratio", "age_main_residence"),
        ("netliquidassets", "hb0900"),
        ("agerefperson", "netliquidassets"),
        ("networth", "hb0900"),
        ("change_absolute", "dnnlaratio"),
        ("change_ratio", "dnnlaratio"),
        ("agerefperson", "networth"),
        ("edurefperson", "networth"),
        ("edurefperson", "netliquidassets"),
        ("edurefperson", "change_absolute"),
        ("agerefperson", "change_absolute"),
        ("agerefperson", "age_main_residence"),
        ("dhgenderh1", "change_absolute"),
        ("change_ratio", "per_capita_consumption"),
        ("change_ratio", "da2101"),
        ("change_ratio", "total_c"),
    ]
}
# Pooled coefficients asked for without leaving out missing values.
STRICT = [p for p in PAIRS if p not in ("change_ratio*per_capita_consumption", "change_ratio*da2101", "change_ratio*total_c")]
PAIR_COLUMNS = [
    "hb0700", "hb0100", "netliquidassets", "networth", "dnnlaratio", "agerefperson", "edurefperson", "dhgenderh1",
    "da2101", "docogood", "dofoodc", "hi0210", "dh0001",
]


def _pair_data(spark, sf_dir):
    df = v.with_consumption(known_change(spark, sf_dir, PAIR_COLUMNS))
    return df.withColumn("age_main_residence", v.residence_age())


@register
def corr_panel(spark, sf_dir):
    """22 correlations, pooled and per country, from one scan."""
    return rounded(models.corr_panel(_pair_data(spark, sf_dir), "sa0100", PAIRS, strict=STRICT), 9)


@register
def corr_test_panel(spark, sf_dir):
    """Tests of the same correlations."""
    out = models.corr_test(_pair_data(spark, sf_dir), "sa0100", PAIRS)
    return rounded(out, {"t": 6, "p": 6}, default=9)


WEALTH_MODELS = {"netliquidassets": ("netliquidassets", "change_absolute"), "networth": ("networth", "change_absolute")}
FIT_DIGITS = {"intercept": 4, "se_intercept": 4, "sigma": 4, "p_": 6}


@register
def ols_simple(spark, sf_dir):
    """Change of the residence value on each wealth measure, top 1 % trimmed."""
    df = _trimmed(spark, sf_dir, ["sa0100", "netliquidassets", "networth", "change_absolute"])
    return rounded(models.ols_simple(df, "sa0100", WEALTH_MODELS), FIT_DIGITS, default=8)


@register
def lm_band(spark, sf_dir):
    """Fitted lines with 95 % bands: the trimmed wealth models and the full-data consumption model."""
    df = _trimmed(spark, sf_dir, ["sa0100", "netliquidassets", "networth", "change_absolute"])
    return rounded(models.lm_band(df, "sa0100", WEALTH_MODELS), 4)


@register
def lm_band_limited(spark, sf_dir):
    """Consumption and savings against the price change, and consumption against capped savings."""
    df = known_change(spark, sf_dir, ["netliquidassets", "di2000"])
    x = F.col("netliquidassets")
    df = df.withColumn("capped_assets", F.when(x.between(0.0, 5_000_000.0), x))
    lines = {
        "consumption": ("change_absolute", "di2000"),
        "savings": ("change_absolute", "netliquidassets"),
        "consumption_by_savings": ("capped_assets", "di2000"),
    }
    return rounded(models.lm_band(df, "sa0100", lines), 4)


def _model_data(spark, sf_dir):
    cols = ["netliquidassets", "networth", "age", "edurefperson", "pa0100", "dh0001", "dh0006", "di2000"]
    return v.with_family(known_change(spark, sf_dir, cols))


def _coefs(df):
    digits = {"estimate": 7, "std_error": 7, "sigma": 4, "t": 6, "f_p": 6, "f": 3, "p": 6}
    return rounded(df, digits, default=9)


@register
def ols_two_regressors(spark, sf_dir):
    return _coefs(models.ols(_model_data(spark, sf_dir), "sa0100", "di2000", ["change_absolute", "age"]))


@register
def ols_aliased(spark, sf_dir):
    """The same with the sum of both regressors as a third: it is left out of the fit, its own row is empty."""
    df = _model_data(spark, sf_dir).withColumn("both", F.col("change_absolute") + F.col("age"))
    return _coefs(models.ols(df, "sa0100", "di2000", ["change_absolute", "age", "both"]))


CONTROLS = ["networth", "age", "edurefperson", "famstruct"]


@register
def ols_consumption(spark, sf_dir):
    return _coefs(models.ols(_model_data(spark, sf_dir), "sa0100", "di2000", ["change_absolute", *CONTROLS]))


@register
def ols_savings(spark, sf_dir):
    return _coefs(models.ols(_model_data(spark, sf_dir), "sa0100", "netliquidassets", ["change_absolute", *CONTROLS]))


@register
def ols_consumption_savings(spark, sf_dir):
    return _coefs(models.ols(_model_data(spark, sf_dir), "sa0100", "di2000", ["netliquidassets", *CONTROLS]))


def _residuals(name, y, xs, doc):
    def query(spark, sf_dir):
        return rounded(models.residual_summary(_model_data(spark, sf_dir), "sa0100", y, xs), 5)

    query.__name__, query.__doc__ = name, doc
    return register(query)


ols_residuals = _residuals(
    "ols_residuals", "di2000", ["change_absolute", "age"], "Quantiles of the residuals of the short consumption model."
)
ols_residuals_consumption = _residuals(
    "ols_residuals_consumption", "di2000", ["change_absolute", *CONTROLS], "Residuals of consumption on the price change."
)
ols_residuals_savings = _residuals(
    "ols_residuals_savings", "netliquidassets", ["change_absolute", *CONTROLS], "Residuals of savings on the price change."
)
ols_residuals_consumption_savings = _residuals(
    "ols_residuals_consumption_savings", "di2000", ["netliquidassets", *CONTROLS], "Residuals of consumption on savings."
)
residuals_liquid_assets = _residuals(
    "residuals_liquid_assets", "netliquidassets", ["change_absolute"], "Residuals of the line through liquid assets."
)
residuals_networth = _residuals("residuals_networth", "networth", ["change_absolute"], "Residuals of the line through net worth.")


IV_DIGITS = {"estimate": 3, "std_error": 1, "sigma": 3}


@register
def iv_consumption_price(spark, sf_dir):
    """Consumption per head on the current value, with the acquisition value as instrument."""
    df = v.with_consumption(known_change(spark, sf_dir, CONSUMPTION))
    return rounded(models.iv(df, "sa0100", "per_capita_consumption", ["hb0900"], ["hb0800"]), IV_DIGITS, default=6)


@register
def iv_consumption_share(spark, sf_dir):
    """Consumption per head on consumption, with its income share as instrument."""
    df = v.with_consumption(known_change(spark, sf_dir, ["docogoodp", *CONSUMPTION]))
    return rounded(models.iv(df, "sa0100", "per_capita_consumption", ["docogood"], ["docogoodp"]), IV_DIGITS, default=6)


# ---- chart data --------------------------------------------------------------------------------------


@register
def box_stats_by_age(spark, sf_dir):
    """Box plots over regions of the region and age profile, one per country, measure and age group."""
    measures = [
        "mean_change_absolute", "median_change_absolute", "median_change_per_sqm", "mean_networth", "median_networth",
        "mean_netliquidassets", "median_netliquidassets",
    ]
    profile = _profile(spark, sf_dir, ["sa0100", "region", "age_group"])
    profile = profile.select("sa0100", "region", "age_group", *measures)
    long = prep.to_long(profile, measures, "measure", "value")
    return rounded(layers.box_stats(long, ["sa0100", "measure", "age_group"], "value"), 5)


@register
def box_stats_behaviour(spark, sf_dir):
    """Consumption and savings by significant increase and country; savings within the axis limits."""
    df = stored_known_change(spark, sf_dir, ["di2000", "netliquidassets"])
    savings = F.col("netliquidassets")
    df = df.select(
        "sa0100",
        v.significant_increase().alias("significant_increase"),
        F.col("di2000").alias("consumption"),
        F.when(savings.between(0.0, 1_000_000.0), savings).alias("savings"),
    )
    long = prep.to_long(df, ["consumption", "savings"], "measure", "value")
    return rounded(layers.box_stats(long, ["measure", "significant_increase", "sa0100"], "value", stored=True), 7)


@register
def box_stats_panel(spark, sf_dir):
    """Box plots of the stacked series by country, series and class of change."""
    df = _series(stored_known_change(spark, sf_dir, CONSUMPTION), [])
    return rounded(layers.box_stats(df, ["country", "iv_model", "change_class"], "value", stored=True), 7)


@register
def box_stats_group(spark, sf_dir):
    """Total consumption per head in the six compared groups, from zero up."""
    df = _groups(stored_known_change(spark, sf_dir, CONSUMPTION)).withColumn("per_head", ratio("total_c", "dh0001"))
    df = layers.within_limits(df, "per_head", low=0)
    return rounded(layers.box_stats(df, ["group"], "per_head", stored=True), 7)


@register
def kde_networth(spark, sf_dir):
    df = known_change(spark, sf_dir, ["networth"])
    out = layers.kernel_density(df, ["sa0100"], "networth")
    return rounded(out, {"density": 14, "bandwidth": 6, "x": 5})


@register
def kde_liquid_assets(spark, sf_dir):
    df = known_change(spark, sf_dir, ["netliquidassets"])
    out = layers.kernel_density(df, ["sa0100"], "netliquidassets")
    return rounded(out, {"density": 13, "bandwidth": 6, "x": 5})


@register
def bin2d_change_assets(spark, sf_dir):
    df = known_change(spark, sf_dir, ["netliquidassets"])
    return rounded(layers.bin2d(df, ["sa0100"], "change_absolute", "netliquidassets", 5000, 500), 4)


@register
def bin2d_bounded(spark, sf_dir):
    """The same scatter of wealth in narrow rectangles, merged to at most 400 in each country."""
    df = known_change(spark, sf_dir, ["netliquidassets"])
    return rounded(layers.bin2d(df, ["sa0100"], "change_absolute", "netliquidassets", 500, 50, most=400), 4)
