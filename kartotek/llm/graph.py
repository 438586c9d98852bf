"""Connected components of a graph given as edges, by rounds of large and small stars.

No round gathers the neighbours of a node: a node's least neighbour comes from a partial aggregate and is joined
back to its edges. Every round is written to the shared folder, so plans stay short and lost executors cost one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.sizing import pinned


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("least"))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than its node moves to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("least", F.least("at", "least"))
    moved = both.join(least, F.col("u") == F.col("at")).filter("v > u")
    return moved.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, moves to the node's least neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = down.join(_least(down), F.col("u") == F.col("at"))
    here = F.explode(F.array("u", "v")).alias("u")
    return moved.select(here, F.col("least").alias("v")).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is linked to, for every node of ``edges`` (u, v) but the roots."""
    now = pinned(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = pinned(_small(_large(now)))
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
