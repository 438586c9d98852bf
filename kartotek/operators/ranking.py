"""Sorting, top rows, and the largest step in a score table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartotek.operators.indexing import row_index
from kartotek.operators.nested import quoted
from kartotek.sizing import settle


def sort_desc(frame: DataFrame, value: str, tie: str) -> DataFrame:
    """All rows by falling value, ties by ``tie``."""
    return frame.orderBy(F.desc(quoted(value)), F.col(quoted(tie)))


def top_rows(frame: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of greatest value."""
    return sort_desc(frame, value, tie).limit(k)


def top_per_group(frame: DataFrame, by: str, value: str, tie: str, k: int = 20, rank: str = "rank") -> DataFrame:
    """The ``k`` rows of greatest value in each group, with their rank from 1.

    The rank filter lets Spark cut each group to ``k`` rows on every map task
    before the shuffle, so a group with most of the rows is no heavier than others.
    """
    within = Window.partitionBy(F.col(quoted(by))).orderBy(F.desc(quoted(value)), F.col(quoted(tie)))
    return frame.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= k)


def max_step(scores: DataFrame, k_col: str = "k", score_col: str = "score") -> DataFrame:
    """The ``k`` at the right end of the largest rise in score, and the rise; the first one on ties.

    A score table is a handful of rows and one window does it. A large one is
    numbered in order and each row joined to the one before it.
    """
    columns = scores.select(F.col(k_col), F.col(score_col).alias("__score"))
    small = settle(columns)
    if small is not None:
        ordered = Window.orderBy(k_col)
        steps = small.select(k_col, (F.col("__score") - F.lag("__score").over(ordered)).alias("step"))
    else:
        numbered = row_index(columns, [k_col], "__at")
        before = numbered.select((F.col("__at") + 1).alias("__at"), F.col("__score").alias("__before"))
        steps = numbered.join(before, "__at").select(k_col, (F.col("__score") - F.col("__before")).alias("step"))
    return steps.filter(F.col("step").isNotNull()).orderBy(F.desc("step"), k_col).limit(1)
