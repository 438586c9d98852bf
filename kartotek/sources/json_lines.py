"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    sampling_ratio: float | None = None,
) -> DataFrame:
    """One row per line. Without a schema Spark reads the data, or a sample of it, once more to infer it.

    A field of the schema that a line lacks is null. Vector columns come back when
    the schema names ``VectorUDT()`` for them.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.json(path)


def write_json(frame: DataFrame, path: str) -> None:
    """Write JSON lines, replacing the whole folder."""
    frame.write.mode("overwrite").json(path)
