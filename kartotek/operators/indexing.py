"""Consecutive row numbers, value indexes and term dictionaries."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartotek.operators.nested import elements, quoted
from kartotek.sizing import lookup_join, pinned, settle

_POSITION_BITS = 33


def row_index(frame: DataFrame, order_by: list[str | Column] | None = None, name: str = "Index") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order, with the number as the first column.

    Without an order the rows are numbered as Spark reads them, with no shuffle.
    ``order_by`` should end in a unique column, which fixes the order of ties and
    lets the range sort cut a frequent leading key into several partitions. The
    sorted rows are written once with their partition and place in it; only the
    row count of each partition reaches the driver, and the start of each
    partition goes back by broadcast (one row per partition).
    """
    place = F.monotonically_increasing_id()
    ordered = frame.orderBy(*order_by) if order_by else frame
    sorted_rows = pinned(ordered.withColumn("__place", place))
    partition = F.shiftrightunsigned("__place", _POSITION_BITS)
    within = F.col("__place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    counts = sorted_rows.groupBy(partition.alias("partition")).count().orderBy("partition").toArrow()
    starts = [0, *accumulate(counts["count"].to_pylist())][: counts.num_rows]
    table = pa.table({"__partition": counts["partition"], "__start": pa.array(starts, pa.int64())})
    offsets = frame.sparkSession.createDataFrame(table)
    numbered = sorted_rows.withColumn("__partition", partition).join(F.broadcast(offsets), "__partition")
    return numbered.select((F.col("__start") + within).alias(name), *[F.col(quoted(c)) for c in frame.columns])


def term_dictionary(frame: DataFrame, term_col: str, name: str = "term_index") -> DataFrame:
    """Distinct terms numbered from 0 in term order; ``term_col`` may hold terms or arrays of terms."""
    column = F.col(quoted(term_col))
    is_array = frame.schema[term_col].dataType.typeName() == "array"
    terms = elements(frame, column if is_array else F.array(column), "term")
    return row_index(terms.distinct(), ["term"], name)


def value_ranks(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, its values numbered by falling frequency, ties by value: ``column, value, rank, n``.

    One aggregation covers all columns.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns]
    )
    counts = (
        frame.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    small = settle(counts)
    if small is not None:
        within = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        return small.withColumn("rank", (F.row_number().over(within) - 1).cast("long"))
    numbered = row_index(counts, ["column", F.desc("n"), "value"], "at")
    first = numbered.groupBy("column").agg(F.min("at").alias("first"))
    joined = lookup_join(numbered, first, ["column"], "inner")
    return joined.select("column", "value", "n", (F.col("at") - F.col("first")).alias("rank"))


def string_index(
    frame: DataFrame, columns: dict[str, str], ranks: DataFrame | None = None, invalid: str = "error"
) -> DataFrame:
    """Add the frequency rank of each column's value as a double, 0 for the most frequent.

    ``columns`` maps a column to its new one. ``ranks`` may come from another frame
    (:func:`value_ranks`); a value it lacks, or a null, is an error, or null with
    ``invalid="null"``.
    """
    ranks = ranks if ranks is not None else value_ranks(frame, list(columns))
    result = frame
    for source, target in columns.items():
        lookup = ranks.filter(F.col("column") == source).select(
            F.col("value").alias(source), F.col("rank").cast("double").alias("__rank")
        )
        joined = lookup_join(result.withColumn("__key", F.col(quoted(source)).cast("string")), lookup.withColumnRenamed(source, "__key"), ["__key"])
        found = F.col("__rank")
        if invalid == "error":
            problem = F.format_string(f"column {source} has a value without an index: %s".replace("`", ""), F.col("__key"))
            found = F.when(found.isNotNull(), found).otherwise(F.raise_error(problem))
        result = joined.select(*[F.col(quoted(c)) for c in result.columns], found.alias(target))
    return result


