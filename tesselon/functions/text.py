"""Text functions: category paths, key normalisation, pseudo-missing tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "NULL", "NA", "N/A")
ENDPOINT_NAMES = ("F_NODE", "T_NODE")


def category_path(*labels: Column) -> Column:
    r"""Labels joined by ' > ', reversibly: '\' is doubled, ' > ' in a label becomes '\ > ', null is '\N', empty stays."""
    escaped = [F.coalesce(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(" > "), F.lit("\\ > ")), F.lit("\\N")) for c in labels]
    return F.concat_ws(" > ", *escaped)


def normalized_key(key: Column) -> Column:
    return F.trim(key.cast("string"))


def is_missing_token(value: Column, tokens: tuple[str, ...] = MISSING) -> Column:
    """Whether text, trimmed and in upper case, stands for no value; so blank text does."""
    return F.upper(F.trim(value)).isin(*tokens)


def has_leading_zero(value: Column) -> Column:
    return F.trim(value).rlike("^0[0-9]+$")


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part, whole)


def is_identifier_name(name: str) -> bool:
    """Whether a column's name says that it identifies rows: it is or ends in ID, speaks of an identifier, or names a link's end."""
    return re.search("(^|_)ID$|IDENTIFIER", name.upper()) is not None or name.upper() in ENDPOINT_NAMES


def run_id(moment: Column) -> Column:
    """A UTC moment as run identifier text in Korean time."""
    return F.concat(F.date_format(F.from_utc_timestamp(moment, "Asia/Seoul"), "yyyyMMdd_HHmmss"), F.lit("_KST"))
