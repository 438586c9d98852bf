"""Counts, averages, descriptive statistics, vector statistics and the F-statistic."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartotek.functions.vector import norm, squared_distance
from kartotek.operators.nested import quoted
from kartotek.sizing import lookup_join, settled_or_pinned


def row_count(frame: DataFrame, name: str = "n") -> DataFrame:
    return frame.agg(F.count("*").alias(name))


def group_count(frame: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Rows per group; null is a group of its own."""
    return frame.groupBy(*[F.col(quoted(c)) for c in by]).agg(F.count("*").alias(name))


def group_average(frame: DataFrame, by: list[str], value: str, name: str = "average") -> DataFrame:
    return frame.groupBy(*[F.col(quoted(c)) for c in by]).agg(F.avg(F.col(quoted(value))).alias(name))


def global_min(frame: DataFrame, column: str, name: str = "minimum") -> DataFrame:
    return frame.agg(F.min(F.col(quoted(column))).alias(name))


def global_sum(frame: DataFrame, column: str, name: str = "total") -> DataFrame:
    return frame.agg(F.sum(F.col(quoted(column))).alias(name))


def distinct_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.select(*[F.col(quoted(c)) for c in columns]).distinct()


def distinct_count(frame: DataFrame, columns: list[str], name: str = "n") -> DataFrame:
    """Number of distinct combinations, a combination of nulls included."""
    return distinct_rows(frame, columns).agg(F.count("*").alias(name))


def describe_columns(frame: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per column (and group): ``column, n, mean, stddev, minimum, maximum``, all as numbers.

    ``stddev`` is that of a sample. One aggregation covers all columns.
    """
    by = by or []

    def summary(c: str) -> Column:
        value = F.col(quoted(c)).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("stddev"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
        )

    grouped = frame.groupBy(*[F.col(quoted(c)) for c in by]).agg(F.array(*[summary(c) for c in columns]).alias("__all"))
    return grouped.select(*[F.col(quoted(c)) for c in by], F.inline("__all"))


def as_vector(frame: DataFrame, column: str) -> Column:
    """The column as an ML vector, whether it is one or a numeric array."""
    if isinstance(frame.schema[column].dataType, VectorUDT):
        return F.col(quoted(column))
    return array_to_vector(F.col(quoted(column)).cast("array<double>"))


def as_array(frame: DataFrame, column: str) -> Column:
    """The column as ``array<double>``, whether it is an ML vector or a numeric array."""
    if isinstance(frame.schema[column].dataType, VectorUDT):
        return vector_to_array(F.col(quoted(column)))
    return F.col(quoted(column)).cast("array<double>")


# Name of a result column, and the summary metric it holds.
_METRICS = {"total": "sum", "mean": "mean", "variance": "variance", "minimum": "min", "maximum": "max"}


def vector_stats(
    frame: DataFrame, features: str, by: list[str] | None = None, wanted: tuple[str, ...] = tuple(_METRICS)
) -> DataFrame:
    """Per group: ``n`` and the arrays ``total, mean, variance, minimum, maximum`` over all positions.

    Rows without a vector are left out. The sums are partial on each map task, so
    a big group is not gathered anywhere. ``wanted`` picks the arrays to work out.
    """
    by = by or []
    rows = frame.filter(F.col(quoted(features)).isNotNull())
    metrics = Summarizer.metrics("count", *[_METRICS[w] for w in wanted]).summary(as_vector(frame, features))
    grouped = rows.groupBy(*[F.col(quoted(c)) for c in by]).agg(metrics.alias("__s"))
    return grouped.select(
        *[F.col(quoted(c)) for c in by],
        F.col("__s.count").alias("n"),
        *[vector_to_array(F.col(f"__s.{_METRICS[w]}")).alias(w) for w in wanted],
    )


def group_mean_vectors(frame: DataFrame, by: str, features: str, name: str = "mean") -> DataFrame:
    """The mean vector of each group, as an array, and its row count ``n``."""
    return vector_stats(frame, features, [by], ("mean",)).withColumnRenamed("mean", name)


def vector_total(frame: DataFrame, features: str, by: list[str] | None = None, name: str = "total") -> DataFrame:
    """Element-wise sum of all vectors, per group when ``by`` is given."""
    by = by or []
    return vector_stats(frame, features, by, ("total",)).drop("n").withColumnRenamed("total", name)


def with_group_means(frame: DataFrame, by: str, features: str, name: str = "group_mean") -> DataFrame:
    """Each row with the mean vector of its group; a row whose group has none gets null."""
    means = group_mean_vectors(frame, by, features, name).select(F.col(quoted(by)), name)
    return lookup_join(frame, settled_or_pinned(means), [by], "left")


def with_norm(frame: DataFrame, features: str, name: str = "norm") -> DataFrame:
    return frame.withColumn(name, norm(as_array(frame, features)))


def f_statistic(frame: DataFrame, group: str, features: str) -> DataFrame:
    """One-way F-statistic of a vector column: ``n_groups, n_rows, between, within, f``.

    ``between`` is the sum of n·|group mean − mean|² over K − 1, ``within`` the sum
    of squared distances to the group mean over N − K. Both follow from count, mean
    and variance per group, so the data is read once and never joined back. Rows
    without group or vector are left out.
    """
    rows = frame.filter(F.col(quoted(group)).isNotNull())
    stats = settled_or_pinned(vector_stats(rows, features, [group], ("mean", "variance")))
    overall = stats.agg(Summarizer.mean(array_to_vector("mean"), F.col("n").cast("double")).alias("m"))
    centred = stats.withColumn("__overall", overall.select(vector_to_array("m")).scalar())
    spread = F.aggregate("variance", F.lit(0.0), lambda total, v: total + v)
    sums = centred.agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") * squared_distance(F.col("mean"), F.col("__overall"))).alias("__between"),
        F.sum((F.col("n") - 1) * spread).alias("__within"),
    )
    between = F.try_divide(F.col("__between"), F.col("n_groups") - 1)
    within = F.try_divide(F.col("__within"), F.col("n_rows") - F.col("n_groups"))
    return sums.select(
        "n_groups", "n_rows", between.alias("between"), within.alias("within"), F.try_divide(between, within).alias("f")
    )
