"""One round of outlier removal with a logistic check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.operators.clusters import OUTLIER_SHARE, assign_clusters, fit_kmeans, kmeans_cross_scores, label_outliers
from kartotek.operators.logistic_path import logistic_search
from kartotek.operators.ranking import max_step
from kartotek.operators.regression import INVERSE_STRENGTHS
from kartotek.operators.sampling import split_by_flag, stratified_split, union_rows
from kartotek.sizing import pinned


def choose_k(scores: DataFrame) -> int:
    """The k at the largest rise in score, or the only one tried."""
    best = max_step(scores).first()
    return int(best["k"] if best is not None else scores.first()["k"])


def one_pass(
    frame: DataFrame,
    ks: tuple[int, ...] = (2, 3),
    features: str = "features",
    id_col: str = "cvrNummer",
    label: str = "label",
    iteration: int = 1,
    threshold: float = OUTLIER_SHARE,
    folds: int = 10,
    inverse_strengths: tuple[float, ...] = INVERSE_STRENGTHS,
    seed: int = 42,
) -> DataFrame:
    """Cluster the rows not yet outliers, mark small clusters, and predict the label on held-out rows.

    Rows with ``isOutlier > 0`` sit the round out and keep what they have; a null
    counts as 0. Of the
    others, rows in clusters with at most ``threshold`` of the rows get
    ``isOutlier = iteration``; a stratified fifth of the rest gets a logistic
    prediction. All other rows of the round have ``predictionLogReg`` NaN.
    """
    if "isOutlier" not in frame.columns:
        raise ValueError(f"isOutlier is not in the frame: {frame.columns}")
    open_rows, earlier = split_by_flag(frame.withColumn("isOutlier", F.coalesce("isOutlier", F.lit(0))), "isOutlier")
    open_rows = open_rows.drop("predictionKmeans", "predictionLogReg").persist()
    k = choose_k(kmeans_cross_scores(open_rows, id_col, ks, features, folds, seed=seed))
    model = fit_kmeans(open_rows, k, features, seed=seed, prediction="predictionKmeans")
    marked = label_outliers(assign_clusters(model, open_rows), "predictionKmeans", threshold, iteration)
    scored = pinned(marked)
    open_rows.unpersist()
    remaining, new_outliers = split_by_flag(scored, "isOutlier")
    split = stratified_split(remaining, label, id_col)
    training = split.filter(~F.col("is_test")).drop("is_test")
    test = split.filter(F.col("is_test")).drop("is_test")
    search = logistic_search(training, id_col, label, features, inverse_strengths)
    predicted = search.transform(test).select(*test.columns, "predictionLogReg")
    no_prediction = F.lit(float("nan"))
    return union_rows(
        training.withColumn("predictionLogReg", no_prediction),
        predicted,
        new_outliers.withColumn("predictionLogReg", no_prediction),
        earlier,
    )
