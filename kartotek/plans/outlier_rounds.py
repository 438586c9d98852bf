"""Rounds of outlier removal until no cluster is small, in a store that survives interruption."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartotek.operators.clusters import OUTLIER_SHARE, kmeans_cross_scores, label_outliers, nearest_centres
from kartotek.operators.kmeans_grid import fit_grid
from kartotek.operators.logistic_path import logistic_search
from kartotek.operators.nested import quoted
from kartotek.operators.regression import INVERSE_STRENGTHS
from kartotek.operators.sampling import stratified_split
from kartotek.plans.outliers import choose_k
from kartotek.sources.parts import part_path, read_parts, whole_parts, write_part

FIGURES = "round int, k int, open_rows long, marked long, tested long, right long"
WORKING = ("predictionKmeans", "isOutlier")


def _folders(store: str) -> tuple[str, str]:
    return f"{store.rstrip('/')}/rows", f"{store.rstrip('/')}/figures"


def round_figures(spark: SparkSession, store: str) -> DataFrame:
    """One row per whole round: ``round, k, open_rows, marked, tested, right``, the last two of the held-out prediction."""
    folder = _folders(store)[1]
    return read_parts(spark, folder, whole_parts(spark, folder), FIGURES)


def _held_out(
    remaining: DataFrame, label: str, id_col: str, features: str, inverse_strengths: tuple[float, ...], folds: int
) -> tuple[int, int]:
    """How many rows of a stratified fifth were predicted, and how many of them rightly; zeros where there is one label."""
    if remaining.select(F.col(quoted(label))).distinct().limit(2).count() < 2:
        return 0, 0
    split = stratified_split(remaining.select(id_col, label, features), label, id_col)
    training, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    predicted = logistic_search(training, id_col, label, features, inverse_strengths, folds).transform(test)
    agrees = F.col("predictionLogReg") == F.col(quoted(label))
    tested, right = predicted.agg(F.count("predictionLogReg"), F.count_if(agrees)).first()
    return int(tested), int(right)


def outlier_rounds(
    frame: DataFrame,
    store: str,
    ks: tuple[int, ...] = (2, 3),
    features: str = "features",
    id_col: str = "cvrNummer",
    label: str = "label",
    threshold: float = OUTLIER_SHARE,
    folds: int = 10,
    label_folds: int = 3,
    inverse_strengths: tuple[float, ...] = INVERSE_STRENGTHS,
    max_rounds: int = 50,
    seed: int = 42,
) -> DataFrame:
    """Cluster the open rows, take the small clusters out, check by a held-out prediction; again until none is small.

    A round writes its open rows with their cluster and flag below ``store`` and then one row of figures, which makes it whole.
    Called again with the same store after any interruption, the function goes on after the last whole round and gives
    the same rows, as starting centres and folds hang on hashes of the rows and not on how they are laid out. Rows
    without a vector belong to no cluster and stay in with a null cluster; an empty frame gives no rounds. ``id_col`` is unique. A round reads
    only the rows that the round before left open, and nothing is joined back: a row that was taken out is
    in the part of that round, and all others are in the last part.

    It stops when a round marks no row, after ``max_rounds``, or when no row is left. Returned are all rows with
    ``predictionKmeans`` of their last round and ``isOutlier``, the round that took the row out or 0. :func:`round_figures` tells the rounds.
    """
    if not isinstance(frame.schema[features].dataType, VectorUDT):
        raise TypeError(f"{features} is not a vector column")
    if max_rounds < 1:
        raise ValueError("max_rounds is less than one")
    spark = frame.sparkSession
    rows_folder, figures_folder = _folders(store)
    base = frame.drop(*WORKING)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in base.schema], T.StructField("predictionKmeans", T.IntegerType()), T.StructField("isOutlier", T.IntegerType())])
    figures = {r["round"]: r for r in round_figures(spark, store).collect()}
    done = 0
    while done + 1 in figures:
        done += 1
    last = figures.get(done)
    while done < max_rounds and (last is None or (last["marked"] and last["open_rows"] > last["marked"])):
        number = done + 1
        if done:
            open_rows = spark.read.schema(schema).parquet(part_path(rows_folder, done)).filter("isOutlier = 0").drop(*WORKING)
        else:
            open_rows = base
        placed = open_rows.filter(F.col(quoted(features)).isNotNull())
        if placed.limit(1).count() == 0:
            break
        k = choose_k(kmeans_cross_scores(placed, id_col, ks, features, folds, seed=seed)) if len(ks) > 1 else ks[0]
        [fit] = fit_grid(placed, (k,), features, seed=seed)
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fit.centres)], "cluster int, coordinates array<double>")
        near = nearest_centres(open_rows, centres, features, "predictionKmeans", "__away").drop("__away")
        marked = label_outliers(near, "predictionKmeans", threshold, number)
        flag = F.when(F.col("predictionKmeans").isNull(), F.lit(0)).otherwise(F.col("isOutlier")).cast("int")
        write_part(marked.withColumn("isOutlier", flag).select(*schema.names), rows_folder, number)
        written = spark.read.schema(schema).parquet(part_path(rows_folder, number))
        n, out = written.agg(F.count("*"), F.count_if(F.col("isOutlier") > 0)).first()
        remaining = written.filter((F.col("isOutlier") == 0) & F.col(quoted(features)).isNotNull())
        tested, right = _held_out(remaining, label, id_col, features, inverse_strengths, label_folds)
        last = {"round": number, "k": len(fit.centres), "open_rows": n, "marked": out, "tested": tested, "right": right}
        write_part(spark.createDataFrame([tuple(last.values())], FIGURES).coalesce(1), figures_folder, number)
        done = number
    if not done:
        return base.withColumns({"predictionKmeans": F.lit(None).cast("int"), "isOutlier": F.lit(0)})
    parts = spark.read.schema(schema).parquet(*[part_path(rows_folder, n) for n in range(1, done)]).filter("isOutlier > 0") if done > 1 else None
    end = spark.read.schema(schema).parquet(part_path(rows_folder, done))
    return end if parts is None else parts.unionByName(end)
