"""Running the stateless operators over files as they arrive.

Expression-only operators take a streaming frame as they take a batch one; the
two functions here open such a frame and write out what there is so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_arriving(
    spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """A streaming frame over a folder to which files are added; the schema must be given."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def process_available(
    stream: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    timeout_seconds: int | None = None,
) -> bool:
    """Apply ``operator`` to all files not seen before, append Parquet to ``output`` and stop.

    ``checkpoint`` remembers which files are done, so a second call adds only newer
    ones. True when everything was written within the time allowed.
    """
    query = (
        operator(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(output)
    )
    return query.awaitTermination(timeout_seconds) if timeout_seconds is not None else query.awaitTermination() is None
