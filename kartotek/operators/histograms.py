"""Histograms with equal or log-spaced bins, and the normal curve over them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.operators.nested import quoted
from kartotek.sizing import lookup_join, settled_or_pinned

# Fixed values
BINS = 50
LOG_LOW, LOG_HIGH, LOG_EDGES = 0, 8, 100


def group_bounds(frame: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Per group ``total, mean, stddev, lo, hi`` of a number column; nulls and NaN are left out.

    ``weight`` names a column saying how many times each row counts. The spread is
    then a second aggregate around the mean, so that large values do not cancel.
    """
    number = F.col(quoted(value)).cast("double")
    keys = [F.col(quoted(c)) for c in by]
    rows = frame.filter(_counts(number))
    low, high = F.min(number).alias("lo"), F.max(number).alias("hi")
    if weight is None:
        return rows.groupBy(*keys).agg(
            F.count("*").alias("total"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("stddev"), low, high
        )
    times = F.col(quoted(weight))
    first = rows.groupBy(*keys).agg(
        F.sum(times).alias("total"), (F.sum(times * number) / F.sum(times)).alias("mean"), low, high
    )
    narrow = rows.select(*keys, number.alias("__x"), times.alias("__times"))
    if by:
        around = lookup_join(narrow, settled_or_pinned(first), by, "inner")
    else:
        around = narrow.withColumn("__m", first.select(F.struct("total", "mean", "lo", "hi")).scalar()).select(
            "__x", "__times", "__m.*"
        )
    gap = F.col("__x") - F.col("mean")
    spread = around.groupBy(*keys, "total", "mean", "lo", "hi").agg(F.sum(F.col("__times") * gap * gap).alias("__squares"))
    stddev = F.when(F.col("total") > 1, F.sqrt(F.col("__squares") / (F.col("total") - 1)))
    return spread.select(*keys, "total", "mean", stddev.alias("stddev"), "lo", "hi")


def _counts(number):
    """Whether a number has a place in a histogram."""
    return number.isNotNull() & ~F.isnan(number)


def histogram(
    frame: DataFrame,
    value: str,
    by: list[str] | None = None,
    bins: int = BINS,
    bounds: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Equal bins between the least and greatest value of each group, empty bins included; nulls and NaN are left out.

    One row per group and bin: ``bin, bin_lo, bin_hi, n, density``. The last bin is
    closed. A group with one single value has all rows in bin 0 and no density.
    ``weight`` names a column saying how many times each row counts.
    """
    by = by or []
    keys = [F.col(quoted(c)) for c in by]
    number = F.col(quoted(value)).cast("double")
    times = F.lit(1).cast("long") if weight is None else F.col(quoted(weight))
    limits = settled_or_pinned(bounds if bounds is not None else group_bounds(frame, value, by, weight))
    limits = limits.select(*keys, "total", "lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"))
    rows = frame.filter(_counts(number)).select(*keys, number.alias("__x"), times.alias("__times"))
    if by:
        rows = lookup_join(rows, limits, by, "inner")
    else:
        rows = rows.withColumn("__l", limits.select(F.struct("lo", "width")).scalar()).select(
            "__x", "__times", "__l.lo", "__l.width"
        )
    at = F.when(F.col("width") == 0, 0).otherwise(
        F.least(F.floor((F.col("__x") - F.col("lo")) / F.nullif("width", F.lit(0.0))), F.lit(bins - 1))
    )
    binned = rows.select(*keys, at.cast("int").alias("bin"), "__times")
    counts = binned.groupBy(*keys, "bin").agg(F.sum("__times").alias("n"))
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = lookup_join(grid, counts, [*by, "bin"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return filled.select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
        n.alias("n"),
        F.try_divide(n.cast("double"), F.col("total") * F.col("width")).alias("density"),
    )


def log_histogram(
    frame: DataFrame,
    value: str,
    by: list[str] | None = None,
    low: int = LOG_LOW,
    high: int = LOG_HIGH,
    edges: int = LOG_EDGES,
) -> DataFrame:
    """Counts between log-spaced edges from ``10**low`` to ``10**high``: ``bin, bin_lo, bin_hi, n``.

    Values outside are not counted, the last bin is closed, and bins without rows
    are left out when groups are asked for, else included.
    """
    by = by or []
    keys = [F.col(quoted(c)) for c in by]
    number = F.col(quoted(value)).cast("double")
    bins = edges - 1
    step = (high - low) / bins
    inside = frame.filter((number >= 10.0**low) & (number <= 10.0**high))
    at = F.least(F.floor((F.log10(number) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    counts = inside.select(*keys, at.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    if not by:
        grid = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        counts = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return counts.select(
        *keys,
        "bin",
        F.pow(F.lit(10.0), low + F.col("bin") * step).alias("bin_lo"),
        F.pow(F.lit(10.0), low + (F.col("bin") + 1) * step).alias("bin_hi"),
        "n",
    )


def normal_fit(bounds: DataFrame, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """The normal density of each group at its bin edges: ``edge_no, edge, density``.

    ``bounds`` is what :func:`group_bounds` gives. A group without spread has no density.
    """
    by = by or []
    edges = bounds.withColumn("edge_no", F.explode(F.sequence(F.lit(0), F.lit(bins))))
    edges = edges.withColumn("edge", F.col("lo") + F.col("edge_no") * ((F.col("hi") - F.col("lo")) / bins))
    spread = F.when(F.col("stddev") > 0, F.col("stddev"))
    z = (F.col("edge") - F.col("mean")) / spread
    density = F.exp(-z * z / 2) / (spread * math.sqrt(2 * math.pi))
    return edges.select(*[F.col(quoted(c)) for c in by], "edge_no", "edge", density.alias("density"))
