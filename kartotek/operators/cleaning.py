"""Filters, typing, renaming, and missing values."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartotek.functions.dates import whole_days
from kartotek.operators.nested import quoted

# Fixed values
UNKNOWN_TEXT = "ukendt"


def keep_values(frame: DataFrame, column: str, values: list[Any]) -> DataFrame:
    """Rows whose column is one of ``values``; null rows go."""
    return frame.filter(F.col(quoted(column)).isin(*values))


def where_all_null(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every listed column is null."""
    return frame.filter(reduce(lambda a, b: a & b, [F.col(quoted(c)).isNull() for c in columns]))


def where_present(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which no listed column is null."""
    return frame.filter(reduce(lambda a, b: a & b, [F.col(quoted(c)).isNotNull() for c in columns]))


def without(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns by name; an absent name changes nothing."""
    return frame.select(*[F.col(quoted(c)) for c in frame.columns if c not in set(columns)])


def prefixed(frame: DataFrame, prefix: str, keep: list[str] | None = None) -> DataFrame:
    """Put ``prefix`` before every column name but those in ``keep``."""
    keep = keep or []
    return frame.select(*[F.col(quoted(c)).alias(c if c in keep else prefix + c) for c in frame.columns])


def with_offset_year(frame: DataFrame, year_col: str = "stiftelsesAar", name: str = "aar", base: int = 2000) -> DataFrame:
    """Years counted from ``base``; null stays null."""
    return frame.withColumn(name, F.col(quoted(year_col)) - F.lit(base))


def cast_columns(frame: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast columns; a text that does not fit its new type becomes null."""
    return frame.withColumns({c: F.col(quoted(c)).try_cast(kind) for c, kind in kinds.items()})


def fill_text(frame: DataFrame, columns: list[str], value: str = UNKNOWN_TEXT) -> DataFrame:
    """Fill missing text in those of ``columns`` that the frame has."""
    present = [c for c in columns if c in frame.columns]
    return frame.fillna(value, subset=present) if present else frame


def fill_zero(frame: DataFrame) -> DataFrame:
    """Fill missing numbers with 0 in every numeric column."""
    return frame.fillna(0)


def impute_mean(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Replace missing numbers by the column's mean over the present ones.

    The columns become double, so the mean is not cut to a whole number. NaN
    counts as missing. All means come from one aggregate, read as a scalar
    subquery: one row, with no join to the data. A column with no value stays null.
    """

    def present(c: str) -> Column:
        value = F.col(quoted(c)).cast("double")
        return F.when(~F.isnan(value), value)

    means = frame.agg(F.struct(*[F.avg(present(c)).alias(f"m{i}") for i, c in enumerate(columns)]).alias("means"))
    filled = {c: F.coalesce(present(c), F.col(f"__means.m{i}")) for i, c in enumerate(columns)}
    return frame.withColumn("__means", means.scalar()).select(
        *[filled.get(c, F.col(quoted(c))).alias(c) for c in frame.columns]
    )


def drop_missing(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any null or NaN."""
    return frame.na.drop(how="any", subset=columns)


def status_durations(
    frame: DataFrame,
    id_col: str = "cvr",
    start_col: str = "gyldigFra",
    end_col: str = "gyldigTil",
    status_col: str = "status",
) -> DataFrame:
    """Length in days of every status interval held in three parallel arrays.

    One row ``difference, status, <id>`` per array position. A missing date counts
    as the far future, the order of the two dates does not matter, and the
    shortest interval is one day.
    """
    zipped = F.arrays_zip(
        F.col(quoted(start_col)).alias("fra"), F.col(quoted(end_col)).alias("til"), F.col(quoted(status_col)).alias("status")
    )
    rows = frame.select(F.col(quoted(id_col)), F.explode(zipped).alias("entry"))
    return rows.select(
        whole_days(F.col("entry.fra"), F.col("entry.til")).alias("difference"),
        F.col("entry.status").alias("status"),
        F.col(quoted(id_col)),
    )
