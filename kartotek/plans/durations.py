"""How long units stay in each status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.functions.text import lower_elements
from kartotek.operators.cleaning import status_durations
from kartotek.operators.histograms import BINS, group_bounds, histogram, normal_fit
from kartotek.sizing import settled_or_pinned


def durations(history: DataFrame, id_col: str = "cvr") -> DataFrame:
    """One row per status interval; statuses in lower case."""
    return status_durations(history.withColumn("status", lower_elements(F.col("status"))), id_col)


def mean_durations(history: DataFrame, id_col: str = "cvr") -> DataFrame:
    """Per status the number of intervals and their mean length: ``status, n, avg_days``."""
    return durations(history, id_col).groupBy("status").agg(
        F.count("*").alias("n"), F.avg("difference").alias("avg_days")
    )


def duration_shapes(intervals: DataFrame, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Per status, the histogram of the log length and the normal curve at its edges.

    Lengths are whole days, so the intervals are first counted by status and
    length. That is the only pass over them; all else works on the counts. A
    status whose mean log length is 0, so one with one-day intervals only, is left out.
    """
    lengths = settled_or_pinned(intervals.groupBy("status", "difference").agg(F.count("*").alias("times")))
    logged = lengths.select("status", F.log("difference").alias("log_days"), "times")
    bounds = group_bounds(logged, "log_days", ["status"], "times").filter(F.col("mean") != 0)
    bounds = settled_or_pinned(bounds)
    bars = histogram(logged, "log_days", ["status"], bins, bounds, "times")
    return bars, normal_fit(bounds, ["status"], bins)
