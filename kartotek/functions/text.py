"""Scalar expressions on text and arrays of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
NO_VALUE_TEXT = "None"
NO_VALUE_NUMBER = 100
ACTIVE_STATUS = "aktiv"


def first_number(text: Column) -> Column:
    """The first run of digits as an int; null when there is none or it does not fit."""
    digits = F.regexp_extract(text.cast("string"), "([0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def as_text(value: Column) -> Column:
    """The value as text, ``"None"`` for null."""
    return F.coalesce(value.cast("string"), F.lit(NO_VALUE_TEXT))


def squeezed_lower(text: Column) -> Column:
    """Lower-cased text with all white space taken out."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def last_status(history: Column, field: str = "status") -> Column:
    """Normalised ``field`` of the last history entry; an empty history gives ``''``."""
    last = F.try_element_at(history, F.lit(-1))
    return F.coalesce(squeezed_lower(last.getField(field)), F.lit(""))


def leading_year(text: Column) -> Column:
    """The first four characters as an int, null when they are not a number."""
    return F.substring(text.cast("string"), 1, 4).try_cast("int")


def code_to_int(text: Column) -> Column:
    """A code as an int; the text ``"None"`` stands for 100."""
    return F.when(text == NO_VALUE_TEXT, F.lit(NO_VALUE_NUMBER)).otherwise(text.try_cast("int"))


def status_label(text: Column, active: str = ACTIVE_STATUS) -> Column:
    """0 for the active status, 1 for everything else and for null."""
    return F.when(text == active, F.lit(0)).otherwise(F.lit(1))


def lower_elements(texts: Column) -> Column:
    """Every element of an array in lower case."""
    return F.transform(texts, F.lower)


def hash_elements(texts: Column) -> Column:
    """A stable 60-bit number for every element of an array, taken from its MD5 digest."""
    return F.transform(texts, lambda t: F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long"))


def words(text: Column) -> Column:
    """Lower-cased words, split at white space; no empty words."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")
