"""Tables that grow by numbered parts, so that an interrupted job goes on after the last whole part."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PART = re.compile(r"part=(\d+)$")


def part_path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/part={number}"


def whole_parts(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the parts that were written to their end, in order; none when the folder is not there.

    Spark leaves a file ``_SUCCESS`` in a part as its last act, so a part of a job that was
    killed has none and does not count.
    """
    context = spark.sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    place = path_of(folder)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [_PART.search(str(entry.getPath().toString())) for entry in files.listStatus(place)]
    return sorted(int(m[1]) for m in found if m and files.exists(path_of(f"{part_path(folder, int(m[1]))}/_SUCCESS")))


def write_part(frame: DataFrame, folder: str, number: int) -> None:
    """Write one part, replacing what an interrupted job has left of it."""
    frame.write.mode("overwrite").parquet(part_path(folder, number))


def read_parts(spark: SparkSession, folder: str, numbers: list[int], schema) -> DataFrame:
    """The rows of the given parts; no parts give no rows."""
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[part_path(folder, n) for n in numbers])
