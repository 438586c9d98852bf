"""Parquet store and ranked CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values
REPORT_COLUMNS = ("cvr", "afstand", "cluster")
REPORT_SEPARATOR = ";"


def write_store(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write Parquet, replacing the whole folder; a partition column lets later filters skip files."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_distance_report(
    frame: DataFrame, path: str, id_col: str, distance_col: str, cluster_col: str, per_cluster: bool = False
) -> None:
    """Rows ``cvr;afstand;cluster`` in CSV, ordered by falling distance.

    The sort is by range, so files in name order are the ranking. With
    ``per_cluster`` there is one folder per cluster instead, and the range runs
    over cluster and distance, so a big cluster is spread over many files.
    """
    cvr, afstand, cluster = REPORT_COLUMNS
    rows = frame.select(
        F.col(id_col).alias(cvr), F.col(distance_col).alias(afstand), F.col(cluster_col).alias(cluster)
    )
    if per_cluster:
        ranked = rows.orderBy(cluster, F.desc(afstand), cvr)
        writer = ranked.write.partitionBy(cluster)
    else:
        writer = rows.orderBy(F.desc(afstand), cvr).write
    writer.mode("overwrite").option("sep", REPORT_SEPARATOR).option("header", True).csv(path)


def read_distance_report(spark: SparkSession, path: str) -> DataFrame:
    cvr, afstand, cluster = REPORT_COLUMNS
    return (
        spark.read.schema(f"{cvr} long, {afstand} double, {cluster} int")
        .option("sep", REPORT_SEPARATOR)
        .option("header", True)
        .csv(path)
    )
