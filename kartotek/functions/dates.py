"""Interval expressions on dates kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
OPEN_END = "2100-01-01"


def closed_date(text: Column) -> Column:
    """The date of a ``yyyy-MM-dd`` text; a missing one is the far future, a malformed one null."""
    return F.when(text.isNull(), F.lit(OPEN_END).cast("date")).otherwise(text.try_cast("date"))


def whole_days(start: Column, end: Column) -> Column:
    """Days between two dates in either order, at least one; null when either is malformed."""
    days = F.abs(F.datediff(closed_date(end), closed_date(start)))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(1)))
