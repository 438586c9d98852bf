"""Samples, exact stratified splits, and putting parts together again."""

from __future__ import annotations

from functools import reduce
from math import ceil, log
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartotek.operators.nested import quoted
from kartotek.sizing import lookup_join, settled_or_pinned

# Fixed values
SAMPLE_FRACTION = 0.01
SAMPLE_SEED = 42


def sample_rows(frame: DataFrame, fraction: float = SAMPLE_FRACTION, seed: int = SAMPLE_SEED) -> DataFrame:
    """About ``fraction`` of all rows, without replacement."""
    return frame.sample(False, fraction, seed)


def sample_by(frame: DataFrame, column: str, fractions: dict[Any, float], seed: int = SAMPLE_SEED) -> DataFrame:
    """About the given fraction of each type; types not named give no rows."""
    return frame.sampleBy(column, fractions, seed)


def sample_by_digest(
    frame: DataFrame, id_col: str, fraction: float = SAMPLE_FRACTION, seed: str = "", by: str | None = None,
    fractions: dict[Any, float] | None = None,
) -> DataFrame:
    """About ``fraction`` of all rows, or the given fraction of each value of ``by``, chosen by the MD5 of seed and id.

    The same rows are chosen in every run and by every engine, however the table is split.
    """
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(quoted(id_col)).cast("string"))), 1, 15), 16, 10)
    share = F.lit(fraction)
    if by is not None:
        share = F.lit(0.0)
        for value, part in (fractions or {}).items():
            share = F.when(F.col(quoted(by)).eqNullSafe(F.lit(value)), F.lit(part)).otherwise(share)
    return frame.filter(place.cast("long") < share * float(1 << 60))


def stratified_split(
    frame: DataFrame,
    label: str,
    id_col: str,
    fraction: float = 0.2,
    seed: str = "",
    flag: str = "is_test",
    bucket_rows: int = 10_000,
) -> DataFrame:
    """Mark exactly the rounded ``fraction`` of every label's rows as test rows; ids are unique.

    Rows rank by the MD5 of ``seed`` and id, so the split is repeatable. No label is
    ever sorted as a whole: rows are counted by label and leading digits of the
    digest, the running count finds the one bucket in which a label's cut lies,
    and only the rows of that bucket, some ``bucket_rows`` at any number of rows, are
    ranked to find the last test row. The result itself is a projection that compares
    each row with its label's cut.
    """
    digits = max(1, ceil(log(max(frame.count() / bucket_rows, 1), 16)))
    label_key = F.col(quoted(label))
    digest = F.md5(F.concat(F.lit(seed), F.col(quoted(id_col)).cast("string")))
    ranks = frame.select(label_key, digest.alias("__digest"), F.col(quoted(id_col)).alias("__id"))
    bucket = F.substring("__digest", 1, digits).alias("__bucket")
    counts = ranks.groupBy(label_key, bucket).agg(F.count("*").alias("__n"))
    running = Window.partitionBy(label_key).orderBy("__bucket")
    through = F.sum("__n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("__n").over(Window.partitionBy(label_key))
    buckets = (
        counts.select(
            label_key,
            "__bucket",
            through.alias("__through"),
            "__n",
            F.floor(total * F.lit(fraction) + 0.5).alias("__target"),
        )
        .filter((F.col("__through") >= F.col("__target")) & (F.col("__through") - F.col("__n") < F.col("__target")))
        .select(label_key, "__bucket", (F.col("__target") - F.col("__through") + F.col("__n")).alias("__need"))
    )
    candidates = lookup_join(ranks.withColumn("__bucket", bucket), settled_or_pinned(buckets), [label, "__bucket"], "inner")
    within = Window.partitionBy(label_key).orderBy("__digest", "__id")
    cuts = candidates.withColumn("__at", F.row_number().over(within)).filter(F.col("__at") == F.col("__need"))
    marked = lookup_join(
        frame, settled_or_pinned(cuts.select(label_key, F.struct("__digest", "__id").alias("__cut"))), [label], "left"
    )
    is_test = F.struct(digest, F.col(quoted(id_col))) <= F.col("__cut")
    return marked.select(*[F.col(quoted(c)) for c in frame.columns], F.coalesce(is_test, F.lit(False)).alias(flag))


def split_by_flag(frame: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose flag is 0, and those whose flag is greater."""
    return frame.filter(F.col(quoted(flag)) == 0), frame.filter(F.col(quoted(flag)) > 0)


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_members(frame: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` occurs in ``members``; null occurs nowhere."""
    keys = members.select(F.col(quoted(column))).filter(F.col(quoted(column)).isNotNull()).distinct()
    return lookup_join(frame, keys, [column], "left_semi")
