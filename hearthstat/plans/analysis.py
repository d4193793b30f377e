"""From person, household and weight tables to the analysed table and its flagship result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hearthstat.functions.expr import cut, is_in, recode
from hearthstat.operators import prep, survey
from hearthstat.plans import variables as v

# Code -> readable name, beyond the income components.
NAMES = {"DHAGEH1B": "age", "DHAGEH1": "agerefperson", "DHEDUH1": "edurefperson"}


def household_table(
    persons: DataFrame, derived: DataFrame, core: DataFrame, countries: Sequence[str] = ("AT", "DE")
) -> DataFrame:
    """One row per household and implicate with its reference person and all derived variables.

    The inputs hold all implicates stacked, with any spelling of the column names. Each is restricted to
    the countries before the joins: the filter cannot cross a join on null-safe keys by itself.
    """
    p, d, h = (
        prep.upper_names(df).where(is_in("SA0100", list(countries))) for df in (persons, derived, core)
    )
    df = prep.attach_reference(prep.merge_households(d, h), p)
    df = v.with_changes(v.with_incomes(v.with_person_variables(prep.rename(df, NAMES))))
    return v.with_consumption(df).withColumns(
        {
            "region": recode("DHREGION", v.REGION_NAMES),
            "age_group": cut("agerefperson", v.AGE_BREAKS, v.AGE_LEVELS),
            "year_acquisition_category": v.acquisition_period(),
            "age_main_residence": v.residence_age(),
            "significant_increase": v.significant_increase(),
            "htm_status": v.hand_to_mouth(),
        }
    )


def weight_table(weights: DataFrame, countries: Sequence[str] = ("AT", "DE")) -> DataFrame:
    """The replicate weights of the countries, missing ones as 0."""
    return prep.fill_missing(prep.upper_names(weights).where(is_in("SA0100", list(countries))))


def change_distribution(
    households: DataFrame, countries: Sequence[str] = ("AT", "DE"), by_period: bool = False
) -> DataFrame:
    """Weighted distribution of the price change within country, or country and period of acquisition."""
    levels = {"change_category": v.CHANGE_LEVELS}
    within = ["SA0100"]
    if by_period:
        levels["year_acquisition_category"] = v.YEAR_LEVELS
        within.append("year_acquisition_category")
    levels["SA0100"] = list(countries)
    design = survey.Design(weight="HW0010", implicate="IM0100")
    mean = survey.implicate_mean(households, levels, design)
    return survey.share(mean, "weighted_count", within)


def with_replicates(households: DataFrame, weights: DataFrame, keys: Sequence[str], first: str, last: str) -> tuple[DataFrame, survey.Design]:
    """The household table with its replicate weights `first` to `last`, and the design they make."""
    names = prep.columns_between(weights, first, last)
    design = survey.Design(
        weight="HW0010", implicate="IM0100", replicates=tuple(names), scale=1.0, rscale=1 / len(names)
    )
    return survey.attach_weights(households, weights, keys, names), design


def comparison_table(households: DataFrame) -> DataFrame:
    """The six compared groups of rising prices, with label."""
    known = households.where(F.col("change_category").isNotNull())
    return prep.tag_subsets(known, v.comparison_groups())
