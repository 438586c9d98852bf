"""Operators, fitted models and group sums run over a stream of files; the result is the same as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import ORACLE, Tables, query
from catalogue.rows import line_histories
from catalogue.vectors import label_centres
from kartotek.operators import clusters, vectors
from kartotek.operators.cleaning import keep_values
from kartotek.plans import clustering
from kartotek.plans.durations import durations
from kartotek.sizing import scratch_path
from kartotek.streaming import process_available, read_arriving
from kartotek.streaming.groups import GroupStore, keep_up, with_bin


def streamed(t: Tables, table: str, columns: list[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Send all rows of a table through a file stream and read what it wrote."""
    source = getattr(t, table).select(*columns)
    output, checkpoint = scratch_path(t.spark, table), scratch_path(t.spark, f"{table}-progress")
    stream = read_arriving(t.spark, f"{t.folder}/{table}.parquet*", source.schema, "parquet")
    process_available(stream, operator, output, checkpoint)
    return t.spark.read.parquet(output)


@query(ORACLE["q_status_filter"])
def q_status_filter_stream(t: Tables) -> DataFrame:
    return streamed(
        t, "orders", ["o_orderkey", "o_orderstatus"], lambda frame: keep_values(frame, "o_orderstatus", ["F", "O"])
    )


@query(ORACLE["q_status_intervals"])
def q_status_intervals_stream(t: Tables) -> DataFrame:
    """Histories are built and cut into intervals as the files arrive."""
    columns = ["l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"]
    intervals = streamed(t, "lineitem", columns, lambda frame: durations(line_histories(frame)))
    return intervals.select("cvr", "status", "difference")


@query(ORACLE["q_kmeans_assign"])
def q_kmeans_assign_stream(t: Tables) -> DataFrame:
    """Vectors get the nearest of given centres as their files arrive."""
    centres = label_centres(t.embeddings)
    near = streamed(t, "embeddings", ["vec_id", "embedding"], lambda frame: clusters.nearest_centres(frame, centres, "embedding"))
    return near.select("vec_id", "prediction", F.round("distance", 6).alias("distance"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ FROM embeddings")
def q_saved_clustering_stream(t: Tables) -> DataFrame:
    """A fitted scaler and K-means model transform a stream: rows whose cluster or distance is not that of the batch are none."""
    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    scaled, scaler = vectors.scale(t.embeddings.select(F.col("vec_id").alias("Index"), vector))
    model = clusters.fit_kmeans(scaled)
    arrived = streamed(
        t, "embeddings", ["vec_id", "embedding"],
        lambda frame: clustering.distances(scaler.transform(frame.select(F.col("vec_id").alias("Index"), vector)), model),
    )
    batch = clustering.distances(scaled, model).toDF("Index", "own", "away")
    differs = (F.col("own") != F.col("prediction")) | (F.abs(F.col("away") - F.col("distance")) > 1e-9)
    return arrived.join(batch, "Index").agg(F.count("*").alias("n"), F.count_if(differs).alias("differ"))


def kept_up(t: Tables, frame: DataFrame, by: list[str], values: list[str], operator: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:
    """Group sums of a table that arrives as five files, one a batch, with the parts merged every third batch."""
    source, folder, checkpoint = (scratch_path(t.spark, n) for n in ("arriving", "groups", "groups-progress"))
    frame.repartition(5).write.parquet(source)
    stream = operator(read_arriving(t.spark, source, frame.schema, "parquet", files_per_batch=1))
    store = GroupStore(folder, stream.schema, by, values, merge_every=3)
    keep_up(stream, store, checkpoint)
    return store.read(t.spark)


@query(
    """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS average,
       min(l_orderkey) AS minimum, max(l_orderkey) AS maximum
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""
)
def q_group_average_stream(t: Tables) -> DataFrame:
    """Counts, averages and extremes per group, kept up over five batches."""
    by, values = ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_orderkey"]
    sums = kept_up(t, t.lineitem.select(*by, *values), by, values)
    return sums.select(
        *by, "n", F.round("l_extendedprice_average", 4).alias("average"),
        F.col("l_orderkey_minimum").alias("minimum"), F.col("l_orderkey_maximum").alias("maximum"),
    )


@query("SELECT event_type, CAST(floor(value / 2.5) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def q_histogram_stream(t: Tables) -> DataFrame:
    """A histogram per type with given edges, kept up over five batches."""
    return kept_up(t, t.events.select("event_type", "value"), ["event_type", "bin"], [], lambda f: with_bin(f, "value", 0, 2.5))
