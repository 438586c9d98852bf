"""Session settings used by the tests and the benchmark.

On a cluster the session comes from the caller; nothing in the library builds
one of its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", name: str = "kartotek", memory: str = "8g") -> SparkSession:
    """A single-machine session with one shuffle partition per core."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
