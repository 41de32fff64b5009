"""Demographic expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Country and age vocabularies.
US = "united-states"
OTHER_ENGLISH = (
    "united-kingdom", "australia", "canada", "new-zealand", "ireland", "singapore",
)
ENGLISH = (US, *OTHER_ENGLISH)
KEPT_COUNTRIES = (
    "united-states", "united-kingdom", "australia", "canada", "germany", "russia",
)
OTHER_COUNTRY = "other_country"
AGES = ("13-15", "16-17", "18-24", "25-34", "35-44", "45-100")
OTHER_AGE = "other_age"

COUNTRY_VOCABULARY = (*KEPT_COUNTRIES, OTHER_COUNTRY)
AGE_VOCABULARY = (*AGES, OTHER_AGE)


def is_in(value: Column, members) -> Column:
    """Membership with null as false."""
    return F.coalesce(value.isin(*members), F.lit(False))


def age_or_other(age: Column) -> Column:
    return F.coalesce(age, F.lit(OTHER_AGE))


def english_speaking(country: Column) -> Column:
    return is_in(country, ENGLISH)


def country_groups(country: Column) -> dict[str, Column]:
    """Three exclusive flags; an unknown country counts as non-English."""
    us = is_in(country, (US,))
    english = is_in(country, OTHER_ENGLISH)
    return {
        "country_us": us,
        "country_english_ex_us": english,
        "country_non_english": ~(us | english),
    }


def lumped_country(country: Column, kept=KEPT_COUNTRIES) -> Column:
    return F.when(is_in(country, kept), country).otherwise(OTHER_COUNTRY)


def dummy_name(prefix: str, value: str) -> str:
    return f"{prefix}_{value.replace('-', '_')}"


def one_hot(value: Column, vocabulary, prefix: str) -> list[Column]:
    """One 0/1 column per vocabulary entry, the same for train and test."""
    return [
        F.when(value == entry, 1).otherwise(0).alias(dummy_name(prefix, entry))
        for entry in vocabulary
    ]


COUNTRY_DUMMIES = tuple(dummy_name("country", v) for v in COUNTRY_VOCABULARY)
AGE_DUMMIES = tuple(dummy_name("age", v) for v in AGE_VOCABULARY)
