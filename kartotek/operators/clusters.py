"""K-means, distances to centres, model choice and outlier clusters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartotek.functions.vector import abs_difference, norm, vector_distance
from kartotek.operators.blocks import entries_of
from kartotek.operators.kmeans_grid import fit_grid
from kartotek.operators.nested import quoted
from kartotek.operators.statistics import as_array
from kartotek.sizing import SMALL_BYTES, lookup_join, settled_or_pinned

# Fixed values
CLUSTERS = 8
MAX_ITERATIONS = 10
TRIED_CLUSTERS = (4, 8, 10, 12, 16)
OUTLIER_SHARE = 0.005


def fit_kmeans(
    frame: DataFrame,
    k: int = CLUSTERS,
    features: str = "scaledfeatures",
    max_iterations: int = MAX_ITERATIONS,
    seed: int = 42,
    prediction: str = "prediction",
) -> KMeansModel:
    """Fit K-means from random starting points with a fixed seed."""
    estimator = KMeans(
        k=k, maxIter=max_iterations, initMode="random", seed=seed, featuresCol=features, predictionCol=prediction
    )
    return estimator.fit(frame)


def assign_clusters(model: KMeansModel, frame: DataFrame) -> DataFrame:
    """Each row with the number of its nearest centre."""
    return model.transform(frame)


def centres_frame(spark: SparkSession, model: KMeansModel) -> DataFrame:
    """The k centres as rows ``cluster, coordinates``, with every coordinate."""
    centres = [[float(x) for x in centre] for centre in model.clusterCenters()]
    table = pa.table(
        {
            "cluster": pa.array(range(len(centres)), pa.int32()),
            "coordinates": pa.array(centres, pa.list_(pa.float64())),
        }
    )
    return spark.createDataFrame(table)


def center_distances(
    frame: DataFrame,
    centres: DataFrame,
    features: str = "scaledfeatures",
    prediction: str = "prediction",
    contribution: str | None = None,
    distance: str = "distance",
) -> DataFrame:
    """Rows with the Euclidean distance to the centre they are assigned to.

    ``contribution`` names an extra column for the absolute difference per
    position. A row whose cluster has no centre is dropped.
    """
    lookup = centres.select(F.col("cluster").alias(prediction), F.col("coordinates").alias("__centre"))
    joined = lookup_join(frame, lookup, [prediction], "inner")
    if contribution is not None:
        difference = abs_difference(as_array(frame, features), F.col("__centre"))
        return joined.withColumn(contribution, difference).withColumn(distance, norm(F.col(contribution))).drop("__centre")
    if isinstance(frame.schema[features].dataType, VectorUDT):
        away = vector_distance(F.col(quoted(features)), F.col("__centre"))
    else:
        away = norm(abs_difference(as_array(frame, features), F.col("__centre")))
    return joined.withColumn(distance, away).drop("__centre")


def _blocks(rows: list[tuple[int, list[float]]], max_bytes: int) -> list[list[tuple[int, list[float]]]]:
    """Centres in blocks of bounded size."""
    width = max((len(point) for _, point in rows), default=1)
    step = max(1, max_bytes // (8 * max(width, 1)))
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def nearest_centres(
    frame: DataFrame,
    centres: DataFrame,
    features: str = "scaledfeatures",
    prediction: str = "prediction",
    distance: str = "distance",
    block_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Assign rows to given centres and measure the distance in one pass; ties go to the lower cluster.

    Arrow hands each batch of vectors over as one matrix, so the distances of a row cost one matrix product
    instead of interpreted array expressions; sparse vectors are used entry by entry and never widened. Centres
    come from a fitted model and so fit the driver; they travel with the function in blocks of ``block_bytes``,
    and the nearest of each block's nearest is a row's centre.
    """
    rows = sorted((row["cluster"], row["coordinates"]) for row in centres.select("cluster", "coordinates").collect())
    is_vector = isinstance(frame.schema[features].dataType, VectorUDT)

    def nearest_of(block):
        numbers, points = [r[0] for r in block], [r[1] for r in block]

        @F.arrow_udf("struct<distance:double,cluster:int>")
        def nearest(vectors):
            import numpy as np
            import pyarrow as pa

            centre = np.asarray(points, dtype=float)
            names = np.asarray(numbers, dtype="int32")
            valid = vectors.is_valid().to_numpy(zero_copy_only=False)
            present = vectors.drop_null()
            if is_vector:
                row, position, value, size = entries_of(present)
                if (size != centre.shape[1]).any():
                    raise ValueError("vector sizes differ from those of the centres")
                own = np.bincount(row, weights=value * value, minlength=len(present))
                dots = np.stack([np.bincount(row, weights=value * c[position], minlength=len(present)) for c in centre], axis=1)
                squared = own[:, None] - 2 * dots + (centre**2).sum(axis=1)
                best = squared.argmin(axis=1)
                chosen = value - centre[best[row], position]
                gone = centre[best[row], position]
                near = np.bincount(row, weights=chosen * chosen - gone * gone, minlength=len(present))
                gaps = np.sqrt(np.maximum(near + (centre[best] ** 2).sum(axis=1), 0.0))
            else:
                values = present.flatten().to_numpy(zero_copy_only=False)
                if len(values) != len(present) * centre.shape[1]:
                    raise ValueError("vector sizes differ from those of the centres")
                matrix = values.reshape(len(present), centre.shape[1])
                squared = (centre**2).sum(axis=1) - 2 * matrix @ centre.T
                best = squared.argmin(axis=1)
                gaps = np.sqrt(((matrix - centre[best]) ** 2).sum(axis=1))
            cluster, away = np.zeros(len(vectors), "int32"), np.zeros(len(vectors))
            cluster[valid], away[valid] = names[best], gaps
            return pa.StructArray.from_arrays(
                [pa.array(away, mask=~valid), pa.array(cluster, mask=~valid)], names=["distance", "cluster"]
            )

        return nearest

    vector = F.unwrap_udt(F.col(quoted(features))) if is_vector else as_array(frame, features)
    found = frame
    blocks = _blocks(rows, block_bytes)
    for i, block in enumerate(blocks):
        found = found.withColumn(f"__nearest{i}", nearest_of(block)(vector))
    names = [f"__nearest{i}" for i in range(len(blocks))]
    best = F.least(*names) if len(names) > 1 else F.col(names[0])
    return found.withColumn("__nearest", best).withColumns(
        {prediction: F.col("__nearest.cluster"), distance: F.col("__nearest.distance")}
    ).drop("__nearest", *names)


def wssse(frame: DataFrame, distance: str = "distance", name: str = "wssse") -> DataFrame:
    """Sum of squared distances to the centres."""
    return frame.agg(F.sum(F.col(quoted(distance)) * F.col(quoted(distance))).alias(name))


def kmeans_scores(
    frame: DataFrame,
    ks: tuple[int, ...] = TRIED_CLUSTERS,
    features: str = "scaledfeatures",
    max_iterations: int = MAX_ITERATIONS,
    seed: int = 42,
) -> DataFrame:
    """Cost on the training rows for each k: ``k, wssse``. All fits share their scans of the rows."""
    fits = fit_grid(frame, tuple(ks), features, max_iterations=max_iterations, seed=seed)
    return frame.sparkSession.createDataFrame([(f.k, f.cost) for f in fits], "k int, wssse double")


def kmeans_cross_scores(
    frame: DataFrame,
    id_col: str,
    ks: tuple[int, ...] = (2, 3, 4),
    features: str = "features",
    folds: int = 10,
    max_iterations: int = MAX_ITERATIONS,
    seed: int = 42,
) -> DataFrame:
    """Held-out score of each k: ``k, score``, the mean over folds of minus the cost on the fold.

    The fold of a row comes from a hash of its id. The fits of all k and folds share their scans of the rows.
    """
    fold = F.pmod(F.xxhash64(F.col(quoted(id_col))), F.lit(folds)).cast("int")
    fits = fit_grid(frame, tuple(ks), features, fold, folds, max_iterations, seed)
    rows = [(f.k, None if f.held_out is None else -f.held_out) for f in fits]
    scores = frame.sparkSession.createDataFrame(rows, "k int, score double")
    return scores.groupBy("k").agg(F.avg("score").alias("score"))


def label_outliers(
    frame: DataFrame,
    prediction: str = "predictionKmeans",
    threshold: float = OUTLIER_SHARE,
    iteration: int = 1,
    flag: str = "isOutlier",
) -> DataFrame:
    """Set ``flag`` to ``iteration`` in clusters with at most ``threshold`` of all rows.

    Other rows keep the flag they have, or get 0.
    """
    counts = settled_or_pinned(frame.groupBy(F.col(quoted(prediction))).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n").alias("total")).scalar()
    sized = counts.withColumn("__total", total)
    small = sized.filter(F.col("__n") <= F.col("__total") * threshold).select(
        F.col(quoted(prediction)), F.lit(True).alias("__small")
    )
    marked = lookup_join(frame, small, [prediction], "left")
    before = F.col(quoted(flag)).cast("int") if flag in frame.columns else F.lit(0)
    value = F.when(F.col("__small"), F.lit(iteration)).otherwise(before)
    return marked.withColumn(flag, value).drop("__small")
