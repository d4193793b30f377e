"""Derived survey variables and the level lists of their categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expr import (
    INF,
    closed_bands,
    cut,
    flag,
    flag_or_zero,
    half_open_bands,
    is_in,
    log_plus_one,
    lookup,
    ratio,
    row_sum,
)

# Fixed values of the analysis.
CHANGE_BREAKS = [0, 0.5, 1, 1.5, 2, INF]
CHANGE_LEVELS = ["Decrease > 50%", "Decrease 0-50%", "Increase 0-50%", "Increase 50-100%", "Increase > 100%"]
YEAR_CUTS = [1980, 1990, 2000, 2010]
YEAR_LEVELS = ["Before 1980", "1980-1989", "1990-1999", "2000-2009", "2010+"]
AGE_BREAKS = [18, 25, 35, 45, 55, 65, 75, 85]
AGE_LEVELS = ["18-25", "26-35", "36-45", "46-55", "56-65", "66-75", "76-85"]
AGE_BANDS = [(20 + 5 * i, 24 + 5 * i, i + 1) for i in range(12)]
QUINTILES = ["lowest", "lower", "middle", "upper middle", "upper"]
FAMILY_LABELS = {
    1: "Not married with kids",
    2: "Not married, no kids, under 55",
    3: "Not married, no kids, over 55",
    4: "Married with kids",
    5: "Married, no kids",
}
REGION_NAMES = {
    "AT11": "Burgenland",
    "AT12": "Lower Austria",
    "AT13": "Vienna",
    "AT21": "Carinthia",
    "AT22": "Styria",
    "AT31": "Upper Austria",
    "AT32": "Salzburg",
    "AT33": "Tyrol",
    "AT34": "Vorarlberg",
    "DENW": "North-Western Germany",
    "DEWW": "Western Germany",
    "DEOS": "Eastern Germany",
    "DESW": "Southern Germany",
}
INCOME_NAMES = {
    "di1100": "employee_income",
    "di1200": "self_employment_inc",
    "di1300": "rental_income_realest",
    "di1400": "income_finassets",
    "di1410": "income_finassets_gr_int",
    "di1412": "interest_payments",
    "di1420": "income_private_businesses",
    "di1500": "pension_incomes",
    "di1510": "pension_incomes_public",
    "di1520": "pension_incomes_priv_occ",
    "di1600": "social_transfers",
    "di1610": "unemployment_benefits",
    "di1620": "other_social_benefits",
    "di1700": "private_transfers",
    "di1800": "other_income",
    "dn3001": "networth",
    "dnnla": "netliquidassets",
}
# Name in a chart group -> class; the six compared groups are country x increase class.
GROUP_CLASSES = ["0-50%", "50-100%", ">100%"]
COUNTRY_NAMES = {"AT": "Austria", "DE": "Germany"}
# Reference year for the age of a residence.
SURVEY_YEAR = 2021


def with_changes(df: DataFrame) -> DataFrame:
    """Ratio, difference and class of the current over the acquisition value."""
    return df.withColumns(
        {"change_ratio": ratio("hb0900", "hb0800"), "change_absolute": F.col("hb0900") - F.col("hb0800")}
    ).withColumn("change_category", cut("change_ratio", CHANGE_BREAKS, CHANGE_LEVELS))


def with_known_change(df: DataFrame) -> DataFrame:
    """`with_changes`, rows without a class removed.

    A class exists where the ratio is not negative. The condition is put on the two values, so that it
    is a plain predicate for the scan and the joins below. NaN, which compares as larger than any number, is no value.
    """
    classed = "NOT isnan(hb0900) AND NOT isnan(hb0800) AND (hb0900 >= 0 AND hb0800 > 0 OR hb0900 > 0 AND hb0800 = 0 OR hb0900 <= 0 AND hb0800 < 0)"
    return with_changes(df.where(classed))


def acquisition_period() -> Column:
    return half_open_bands("hb0700", YEAR_CUTS, YEAR_LEVELS)


def residence_age() -> Column:
    """Years since the acquisition; 0 if its year is unknown."""
    return F.coalesce(F.lit(SURVEY_YEAR) - F.col("hb0700"), F.lit(0))


def with_person_variables(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "agedum": closed_bands("age", AGE_BANDS),
            "female": flag(F.col("ra0200") == 1),
            "edcat": F.col("pa0200"),
            "working": flag(F.col("pe0100a") == 1),
            "married": flag_or_zero(is_in("pa0100", [2, 3])),
            "college": flag_or_zero(F.col("pa0200") >= 5),
        }
    )
    return with_family(df)


def with_family(df: DataFrame) -> DataFrame:
    """Family structure from marriage, children and age; NULL where no rule holds."""
    df = df.withColumns(
        {
            "married": flag_or_zero(is_in("pa0100", [2, 3])),
            "children": F.col("dh0001") - F.col("dh0006"),
        }
    )
    single, couple = F.col("married") == 0, F.col("married") == 1
    kids, none = F.col("children") > 0, F.col("children") == 0
    code = (
        F.when(single & kids, 1)
        .when(single & none & (F.col("age") <= 55), 2)
        .when(single & none & (F.col("age") > 55), 3)
        .when(couple & kids, 4)
        .when(couple & none, 5)
    )
    return df.withColumn("famstruct", code).withColumn("family", lookup("famstruct", FAMILY_LABELS))


def with_incomes(df: DataFrame) -> DataFrame:
    """Readable income names and the three income aggregates."""
    core = ["employee_income", "social_transfers", "private_transfers", "pension_incomes"]
    rest = ["self_employment_inc", "income_private_businesses", "rental_income_realest", "income_finassets"]
    df = df.withColumnsRenamed(INCOME_NAMES).withColumn("income", row_sum(core))
    return df.withColumns({"income_psid": row_sum(["income", *rest]), "total_gross_income": row_sum([*core, *rest])})


def with_consumption(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "log_consumption": log_plus_one("docogood"),
            "per_capita_consumption": ratio("docogood", "dh0001"),
            "total_c": F.col("dofoodc") + F.col("hi0210") * 12 + F.col("docogood"),
        }
    )


def significant_increase() -> Column:
    return flag(F.col("change_category") == CHANGE_LEVELS[-1])


def hand_to_mouth() -> Column:
    """1 if net liquid assets are at most half a month's income."""
    return flag(F.col("netliquidassets") <= F.col("total_gross_income") / 24)


def comparison_groups() -> list[tuple[Column, str]]:
    """The six compared subsets and their labels; decreases belong to none."""
    return [
        ((F.col("sa0100") == code) & (F.col("change_category") == level), f"{country} {cls}")
        for code, country in COUNTRY_NAMES.items()
        for level, cls in zip(CHANGE_LEVELS[2:], GROUP_CLASSES)
    ]
