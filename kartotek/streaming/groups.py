"""Counts, sums and averages per group, and histograms, kept up as files arrive.

Every micro-batch adds one part of partial sums to a store, and every so often a part holds the sums of all parts before
it, so that a reader adds up few. A part is named by its batch and replaced when the batch runs again after a failure, so
each row counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartotek.operators.nested import quoted
from kartotek.sources.parts import part_path, read_parts, whole_parts, write_part

MERGE_EVERY = 16
# Types that are summed as whole numbers of 38 digits, so that no order of batches changes a sum.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class GroupStore:
    """Partial sums of ``values`` per group of ``by`` below ``folder``, both taken from ``schema``.

    Nulls are a group of their own and count in ``rows`` only; NaN makes a sum NaN.
    """

    folder: str
    schema: T.StructType
    by: list[str]
    values: list[str]
    merge_every: int = MERGE_EVERY

    def _kinds(self) -> T.StructType:
        fields = [T.StructField(f"by_{c}", self.schema[c].dataType) for c in self.by]
        fields.append(T.StructField("rows", T.LongType()))
        for v in self.values:
            kind = self.schema[v].dataType
            total = T.DecimalType(38, 0) if isinstance(kind, _WHOLE) else T.DoubleType()
            fields += [
                T.StructField(f"n_{v}", T.LongType()), T.StructField(f"total_{v}", total),
                T.StructField(f"least_{v}", kind), T.StructField(f"most_{v}", kind),
            ]
        return T.StructType(fields)

    def _partial(self, frame: DataFrame) -> DataFrame:
        sums: list[Column] = [F.count(F.lit(1)).alias("rows")]
        kinds = self._kinds()
        for v in self.values:
            value = F.col(quoted(v))
            sums += [
                F.count(value).alias(f"n_{v}"), F.sum(value.cast(kinds[f"total_{v}"].dataType)).alias(f"total_{v}"),
                F.min(value).alias(f"least_{v}"), F.max(value).alias(f"most_{v}"),
            ]
        return frame.groupBy(*[F.col(quoted(c)).alias(f"by_{c}") for c in self.by]).agg(*sums)

    def _merged(self, parts: DataFrame) -> DataFrame:
        how = {"n": F.sum, "total": F.sum, "least": F.min, "most": F.max}
        kept = [f for v in self.values for f in (f"n_{v}", f"total_{v}", f"least_{v}", f"most_{v}")]
        sums = [F.sum("rows").alias("rows"), *[how[f.split("_", 1)[0]](F.col(quoted(f))).alias(f) for f in kept]]
        merged = parts.groupBy(*[F.col(quoted(f"by_{c}")) for c in self.by]).agg(*sums)
        return merged.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in self._kinds().fields])

    def _covering(self, numbers: list[int]) -> list[int]:
        """The last part that holds all before it, and those after."""
        merged = [n for n in numbers if self._merges(n)]
        return [n for n in numbers if not merged or n >= merged[-1]]

    def _merges(self, number: int) -> bool:
        return number % self.merge_every == self.merge_every - 1

    def add(self, batch: DataFrame, number: int) -> None:
        """Add batch ``number``, or put it in the place of what a broken run left of it; meant for ``foreachBatch``."""
        partial = self._partial(batch)
        kinds = self._kinds()
        partial = partial.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in kinds.fields])
        spark = batch.sparkSession
        if self._merges(number):
            earlier = self._covering([n for n in whole_parts(spark, self.folder) if n < number])
            partial = self._merged(read_parts(spark, self.folder, earlier, kinds).unionByName(partial))
        write_part(partial, self.folder, number)

    def read(self, spark: SparkSession) -> DataFrame:
        """The groups so far: the ``by`` columns, ``n``, and per value ``<v>_n, _total, _average, _minimum, _maximum``."""
        parts = read_parts(spark, self.folder, self._covering(whole_parts(spark, self.folder)), self._kinds())
        columns = [F.col(quoted(f"by_{c}")).alias(c) for c in self.by] + [F.col("rows").alias("n")]
        for v in self.values:
            n, total = F.col(quoted(f"n_{v}")), F.col(quoted(f"total_{v}"))
            columns += [
                n.alias(f"{v}_n"), total.alias(f"{v}_total"), F.try_divide(total.cast("double"), n).alias(f"{v}_average"),
                F.col(quoted(f"least_{v}")).alias(f"{v}_minimum"), F.col(quoted(f"most_{v}")).alias(f"{v}_maximum"),
            ]
        return self._merged(parts).select(*columns)


def keep_up(stream: DataFrame, store: GroupStore, checkpoint: str, timeout_seconds: int | None = None) -> bool:
    """Add all files not seen before to the store and stop; True when that was done within the time allowed."""
    query = (
        stream.writeStream.foreachBatch(store.add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return query.awaitTermination(timeout_seconds) if timeout_seconds is not None else query.awaitTermination() is None


def with_bin(frame: DataFrame, value: str, low: float, width: float, name: str = "bin") -> DataFrame:
    """Rows with the number of their bin of fixed width from ``low`` on, below it negative; null and NaN rows are left out.

    The edges are given and not found in the data, so bins of one batch are those of all
    others, and a histogram is the count per group of ``name``.
    """
    number = F.col(quoted(value)).cast("double")
    return frame.filter(number.isNotNull() & ~F.isnan(number)).withColumn(name, F.floor((number - low) / width))
