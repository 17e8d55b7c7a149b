"""Normalisation of raw entity values, as column expressions.

Patterns carry ``(?U)`` where letters and spaces of every script count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading honorifics that are not part of a person's name.
HONORIFICS = ["mr.", "mrs.", "ms.", "dr.", "prof.", "shri", "smt.", "mr", "mrs", "ms", "dr", "prof"]
# Legal-form words that are not part of an organisation's name.
LEGAL_FORMS = ["pvt", "ltd", "inc", "corp", "corporation", "private", "limited"]
# Entity type spellings per normaliser.
PERSON_TYPES = ["PERSON", "PERSONNAME"]
PHONE_TYPES = ["PHONENUMBER", "PHONE", "PHONE_NUMBER"]
EMAIL_TYPES = ["EMAIL", "EMAILADDRESS", "EMAIL_ADDRESS"]
VEHICLE_TYPES = ["VEHICLE", "VEHICLEPLATE"]
LOCATION_TYPES = ["LOCATION", "ADDRESS"]
ORGANIZATION_TYPES = ["ORGANIZATION", "ORG"]
ACCOUNT_TYPES = ["BANKACCOUNT", "ACCOUNT", "FINANCIAL", "IFSC", "UPI"]

COORDINATES = r"^(?U)\s*([\-+]?\d+(?:\.\d+)?)\s*,\s*([\-+]?\d+(?:\.\d+)?)\s*$"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def collapse(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def title(value: Column) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest."""
    runs = F.regexp_extract_all(value, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    cased = F.transform(
        runs, lambda run: F.concat(F.upper(run.substr(1, 1)), F.lower(run.substr(F.lit(2), F.length(run))))
    )
    return F.array_join(cased, "")


def _or_empty(value: Column, normalized: Column) -> Column:
    return F.when(value.isNull() | (value == ""), F.lit("")).otherwise(normalized)


def norm_person(value: Column) -> Column:
    options = "|".join(word.replace(".", r"\.") for word in HONORIFICS)
    bare = F.regexp_replace(strip(value), rf"(?iU)^(?:{options})\s+", "")
    return _or_empty(value, title(collapse(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))))


def norm_phone(value: Column) -> Column:
    def by_length(digits: Column) -> Column:
        size = F.length(digits)
        return (
            F.when(size == 0, F.lit(""))
            .when(size == 10, F.concat(F.lit("+91"), digits))
            .when((size == 12) & digits.startswith("91"), F.concat(F.lit("+"), digits))
            .when((size == 11) & digits.startswith("0"), F.concat(F.lit("+91"), digits.substr(2, 10)))
            .when(value.startswith("+"), F.concat(F.lit("+"), digits))
            .otherwise(digits)
        )

    return _or_empty(value, bind(F.regexp_replace(value, r"(?U)[^\d]", ""), by_length))


def norm_email(value: Column) -> Column:
    return _or_empty(value, F.lower(strip(value)))


def norm_compact(value: Column) -> Column:
    """Vehicle plates and account numbers: no spaces, dots or dashes, upper case."""
    return _or_empty(value, F.upper(F.regexp_replace(value, r"(?U)[\s.\-]", "")))


def coordinate_pair(latitude: Column, longitude: Column) -> Column:
    """``lat, lon`` with five decimals, half-even."""
    return F.format_string("%.5f, %.5f", F.bround(latitude, 5), F.bround(longitude, 5))


def norm_location(value: Column) -> Column:
    latitude = F.regexp_extract(value, COORDINATES, 1).try_cast("double")
    longitude = F.regexp_extract(value, COORDINATES, 2).try_cast("double")
    words = title(collapse(F.regexp_replace(value, r"(?U)[^\w\s]", " ")))
    pair = F.when(latitude.isNotNull() & longitude.isNotNull(), coordinate_pair(latitude, longitude))
    return _or_empty(value, F.coalesce(pair, words))


def norm_org(value: Column) -> Column:
    options = "|".join(LEGAL_FORMS)
    bare = F.regexp_replace(strip(value), rf"(?iU)\b(?:{options})\b", "")
    return _or_empty(value, title(collapse(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))))


def norm_dispatch(entity_type: Column, value: Column) -> Column:
    """Normalise by entity type; unknown types only collapse their spaces."""
    kind = F.upper(entity_type)
    return (
        F.when(kind.isin(PERSON_TYPES), norm_person(value))
        .when(kind.isin(PHONE_TYPES), norm_phone(value))
        .when(kind.isin(EMAIL_TYPES), norm_email(value))
        .when(kind.isin(VEHICLE_TYPES), norm_compact(value))
        .when(kind.isin(LOCATION_TYPES), norm_location(value))
        .when(kind.isin(ORGANIZATION_TYPES), norm_org(value))
        .when(kind.isin(ACCOUNT_TYPES), norm_compact(value))
        .otherwise(collapse(value))
    )


def type_to_label(entity_type: Column) -> Column:
    """One of the seven node labels; anything unknown is a Person."""
    kind = F.upper(entity_type)
    return (
        F.when(kind.isin(PHONE_TYPES), F.lit("PhoneNumber"))
        .when(kind.isin(EMAIL_TYPES), F.lit("Email"))
        .when(kind.isin(PERSON_TYPES), F.lit("Person"))
        .when(kind.isin(VEHICLE_TYPES), F.lit("Vehicle"))
        .when(kind.isin(LOCATION_TYPES), F.lit("Location"))
        .when(kind.isin([*ORGANIZATION_TYPES, "COMPANY"]), F.lit("Organization"))
        .when(kind.isin(["BANKACCOUNT", "ACCOUNT", "FINANCIAL"]), F.lit("BankAccount"))
        .otherwise(F.lit("Person"))
    )


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds to signed decimal degrees; S and W are negative."""
    size = degrees + minutes / F.lit(60.0) + seconds / F.lit(3600.0)
    return F.when(F.upper(ref).isin("S", "W"), -size).otherwise(size)


def phone_digits_ok(value: Column) -> Column:
    """10 to 15 digits, more than two of them different."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    distinct = F.size(F.array_distinct(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))))
    return F.length(digits).between(10, 15) & (distinct > 2)
