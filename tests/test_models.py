from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kartotek.operators import clusters, confusion, regression
from kartotek.plans import outliers
from kartotek.sources import models


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture(scope="module")
def blobs(spark):
    """Three clear groups of 60, 40 and 2 rows; the label follows the first coordinate."""
    generator = np.random.default_rng(5)
    data = []
    for centre, n in ((0.0, 60), (10.0, 40), (100.0, 2)):
        for _ in range(n):
            x = generator.normal(centre, 1, 3)
            data.append((len(data), int(x[0] > 5) if len(data) % 9 else int(x[0] <= 5), Vectors.dense(x)))
    return spark.createDataFrame(data, ["cvrNummer", "label", "features"]).withColumn("label", F.col("label").cast("int")).cache()


@pytest.fixture(scope="module")
def fitted(blobs):
    return clusters.fit_kmeans(blobs, 3, "features", seed=1)


def test_every_row_is_at_its_nearest_centre(spark, blobs, fitted):
    assigned = clusters.assign_clusters(fitted, blobs)
    centres = clusters.centres_frame(spark, fitted)
    measured = clusters.center_distances(assigned, centres, "features", contribution="contribution")
    points = np.array(fitted.clusterCenters())
    for r in measured.collect():
        gaps = np.linalg.norm(points - r["features"].toArray(), axis=1)
        assert gaps.argmin() == r["prediction"] and gaps.min() == pytest.approx(r["distance"])
        assert r["contribution"] == pytest.approx(np.abs(points[r["prediction"]] - r["features"].toArray()))
    near = clusters.nearest_centres(blobs, centres, "features")
    assert sorted(rows(near.select("cvrNummer", "prediction"))) == sorted(rows(measured.select("cvrNummer", "prediction")))
    cost = clusters.wssse(near).first()[0]
    assert cost == pytest.approx(clusters.wssse(measured).first()[0]) == pytest.approx(fitted.summary.trainingCost)


def test_centres_keep_negative_coordinates(spark, fitted):
    got = {r["cluster"]: r["coordinates"] for r in clusters.centres_frame(spark, fitted).collect()}
    assert all(got[i] == pytest.approx(list(c)) for i, c in enumerate(fitted.clusterCenters()))
    assert min(min(c) for c in got.values()) < 0


def test_nearest_centres_edges(spark):
    centres = spark.createDataFrame([(7, [0.0, 0.0]), (3, [0.0, 0.0]), (9, [4.0, 0.0])], "cluster int, coordinates array<double>")
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [4.0, 3.0])], "id int, v array<double>")
    got = sorted(rows(clusters.nearest_centres(frame, centres, "v").drop("v")))
    assert got == [(1, 3, 1.0), (2, None, None), (3, 9, 3.0)]
    with pytest.raises(Exception, match="vector sizes differ"):
        clusters.nearest_centres(spark.createDataFrame([([1.0],)], "v array<double>"), centres, "v").collect()


def test_many_centres_in_blocks(spark, blobs, fitted):
    centres = clusters.centres_frame(spark, fitted)
    whole, parts = (clusters.nearest_centres(blobs, centres, "features", block_bytes=b) for b in (1 << 20, 1))
    columns = ["cvrNummer", "prediction", "distance"]
    assert sorted(rows(whole.select(*columns))) == sorted(rows(parts.select(*columns)))


def test_sparse_vectors_are_not_widened(spark):
    wide = 1_000_000
    data = [(0, Vectors.sparse(wide, {0: 3.0, 999_999: 4.0})), (1, Vectors.sparse(wide, {})), (0, None)]
    frame = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], ["id", "prediction", "v"])
    centres = spark.createDataFrame(
        [(0, [0.0] * wide), (1, [2.0] + [0.0] * (wide - 1))], "cluster int, coordinates array<double>"
    )
    got = {r["id"]: r["distance"] for r in clusters.center_distances(frame, centres, "v").collect()}
    assert got == {0: pytest.approx(5.0), 1: pytest.approx(2.0), 2: None}
    near = {r["id"]: (r["prediction"], r["distance"]) for r in clusters.nearest_centres(frame, centres, "v").collect()}
    assert near[0] == (1, pytest.approx(math.sqrt(17))) and near[1] == (0, 0.0) and near[2] == (None, None)


def test_cost_falls_with_iterations_and_clusters(blobs):
    costs = [clusters.fit_kmeans(blobs, 3, "features", n, seed=2).summary.trainingCost for n in (1, 3, 10)]
    assert costs[1] <= costs[0] * (1 + 1e-9) and costs[2] <= costs[1] * (1 + 1e-9)
    scores = dict(rows(clusters.kmeans_scores(blobs, (2, 8), "features")))
    assert scores[8] < scores[2]


def test_model_reload(spark, blobs, fitted, tmp_path):
    models.save_model(fitted, str(tmp_path / "m"))
    models.save_model(fitted, str(tmp_path / "m"))
    again = models.load_model(KMeansModel, str(tmp_path / "m"))
    assert rows(again.transform(blobs)) == rows(fitted.transform(blobs))


def test_cross_scores(blobs):
    scores = dict(rows(clusters.kmeans_cross_scores(blobs, "cvrNummer", (2, 3), folds=3)))
    assert set(scores) == {2, 3} and all(s < 0 for s in scores.values())
    with pytest.raises(TypeError):
        clusters.kmeans_cross_scores(blobs.withColumn("features", F.array(F.lit(1.0))), "cvrNummer")


def test_label_outliers(spark):
    data = [(i, 0) for i in range(94)] + [(i, 1) for i in range(94, 99)] + [(99, 2)]
    frame = spark.createDataFrame(data, "id int, predictionKmeans int")
    got = clusters.label_outliers(frame, threshold=0.05)
    counts = {(r["predictionKmeans"], r["isOutlier"]) for r in got.select("predictionKmeans", "isOutlier").distinct().collect()}
    assert counts == {(0, 0), (1, 1), (2, 1)}
    again = clusters.label_outliers(got, threshold=0.01, iteration=2)
    counts = {(r["predictionKmeans"], r["isOutlier"]) for r in again.select("predictionKmeans", "isOutlier").distinct().collect()}
    assert counts == {(0, 0), (1, 1), (2, 2)}


def test_choose_k(spark):
    scores = spark.createDataFrame([(2, -9.0), (3, -2.0), (4, -1.0)], "k int, score double")
    assert outliers.choose_k(scores) == 3
    assert outliers.choose_k(scores.filter("k = 2")) == 2


def test_one_pass(blobs):
    earlier = blobs.limit(5).select((F.col("cvrNummer") + 1000).alias("cvrNummer"), "label", "features").withColumns(
        {"isOutlier": F.lit(1), "predictionKmeans": F.lit(9), "predictionLogReg": F.lit(1.0)}
    )
    frame = blobs.withColumns(
        {"isOutlier": F.lit(0), "predictionKmeans": F.lit(None).cast("int"), "predictionLogReg": F.lit(None).cast("double")}
    ).unionByName(earlier)
    done = outliers.one_pass(frame, (3,), folds=2, iteration=2, threshold=0.05, inverse_strengths=(0.1, 0.999)).collect()
    assert len(done) == 107 and len({r["cvrNummer"] for r in done}) == 107
    kept = [r for r in done if r["cvrNummer"] >= 1000]
    assert all((r["isOutlier"], r["predictionKmeans"], r["predictionLogReg"]) == (1, 9, 1.0) for r in kept)
    new = [r for r in done if r["isOutlier"] == 2]
    assert all(math.isnan(r["predictionLogReg"]) for r in new)
    rest = [r for r in done if r["isOutlier"] == 0]
    predicted = [r for r in rest if not math.isnan(r["predictionLogReg"])]
    by_label = [sum(r["label"] == y for r in rest) for y in (0, 1)]
    assert len(predicted) == sum(int(n * 0.2 + 0.5) for n in by_label)
    with pytest.raises(ValueError, match="isOutlier"):
        outliers.one_pass(blobs)


def test_confusion(spark):
    data = [(1, 1.0), (1, 1.0), (0, 0.0), (0, 1.0), (1, 0.0), (1, float("nan")), (0, None)]
    frame = spark.createDataFrame(data, "label int, predictionLogReg double")
    assert rows(confusion.confusion_table(frame)) == [(2, 1, 1, 1, 2, 3 / 5)]
    assert rows(confusion.confusion_table(frame.filter("label = 9"))) == [(0, 0, 0, 0, 0, None)]


@pytest.fixture(scope="module")
def logistic(spark):
    generator = np.random.default_rng(9)
    data = []
    for _ in range(400):
        x = generator.normal(0, 1, 2)
        p = 1 / (1 + math.exp(-(0.5 + 1.5 * x[0])))
        data.append((int(generator.uniform() < p), Vectors.dense(x)))
    return spark.createDataFrame(data, ["label", "features"]).cache()


def test_binomial(spark, logistic):
    model = regression.fit_binomial(logistic)
    table = {r["term"]: r for r in regression.coefficient_table(spark, model, ["a", "b"]).collect()}
    assert list(table) == ["a", "b", "Intercept"]
    assert abs(table["a"]["estimate"] - 1.5) < 0.5 and abs(table["Intercept"]["estimate"] - 0.5) < 0.4
    assert table["a"]["p_value"] < 0.001
    for r in table.values():
        assert r["t_value"] == pytest.approx(r["estimate"] / r["standard_error"])
    summary = regression.binomial_summary(spark, model).first()
    residuals = regression.deviance_residuals(model, model.summary.predictions, ["label"])
    assert residuals.count() == 400
    total = residuals.agg(F.sum(F.pow("devianceResiduals", F.lit(2)))).first()[0]
    assert total == pytest.approx(summary["deviance"]) and summary["null_deviance"] > summary["deviance"]
    assert (summary["dof_null"], summary["dof"]) == (399, 397)
    with pytest.raises(ValueError):
        regression.coefficient_table(spark, model, ["a"])


def test_pipeline(spark, logistic, tmp_path):
    flat = logistic.select("label", *[vector_to_array("features")[i].alias(n) for i, n in enumerate("ab")])
    model = regression.binomial_pipeline(["a", "b"]).fit(flat)
    models.save_model(model, str(tmp_path / "p"))
    again = models.load_model(PipelineModel, str(tmp_path / "p"))
    assert rows(again.transform(flat)) == rows(model.transform(flat))
    assert list(model.stages[-1].coefficients) == pytest.approx(list(regression.fit_binomial(logistic).coefficients))


def test_logistic_grid(logistic):
    search = regression.fit_logistic_grid(logistic, inverse_strengths=(0.1, 0.999))
    assert len(search.avgMetrics) == 2
    table = confusion.confusion_table(search.transform(logistic)).first()
    assert table["accuracy"] > 0.7 and table["Excluded"] == 0
    n = 400
    penalties = sorted(list(m.values())[0] for m in search.getEstimatorParamMaps())
    assert penalties == pytest.approx(sorted(1 / (c * n) for c in (0.1, 0.999)))


def test_elastic_net(logistic):
    model = regression.fit_elastic_net(logistic)
    assert model.intercept == 0 and model.coefficients.size == 2


def test_binomial_fit_reads_its_rows_once(spark):
    """The rows of a fit are worked out once, and not for every step."""
    from pyspark.ml.functions import array_to_vector

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    numbers = spark.range(0, 4_000, 1, 4).selectExpr("id", "cast(id % 7 % 2 AS double) AS label", "array(cast(id % 5 AS double), cast(id % 3 AS double)) AS x")
    frame = numbers.mapInArrow(counted, numbers.schema).select("label", array_to_vector(F.col("x")).alias("features"))
    model = regression.fit_binomial(frame)
    told = regression.coefficient_table(spark, model, ["a", "b"])
    assert told.count() == 3 and model.summary.numIterations > 1
    assert seen.value <= 2 * 4_000
