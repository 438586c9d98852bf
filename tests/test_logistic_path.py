from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kartotek.operators import logistic_path


@pytest.fixture(scope="module")
def frame(spark):
    generator = np.random.default_rng(4)
    x = np.column_stack([generator.normal(0, 1, (300, 3)), generator.normal(5, 20, 300), np.ones(300) * 2, generator.random(300) < 0.1])
    p = 1 / (1 + np.exp(-(x @ np.array([1.0, -2.0, 0.0, 0.05, 0.0, 1.0]) - 0.5)))
    y = generator.random(300) < p
    data = [(i, float(y[i]), Vectors.dense(x[i]) if i % 2 else Vectors.sparse(6, {j: v for j, v in enumerate(x[i]) if v})) for i in range(300)]
    return spark.createDataFrame([*data, (900, None, data[0][2]), (901, 1.0, None)], ["key", "label", "features"]).repartition(4)


@pytest.mark.parametrize("mixing,standardize,intercept", [(0.0, False, True), (0.8, True, False), (0.5, True, True), (1.0, False, True)])
def test_fits_are_those_of_the_engine_run_to_the_end(frame, mixing, standardize, intercept):
    penalties = (0.3, 0.02, 0.001)
    fits = logistic_path.fit_paths(frame, penalties, mixing, intercept=intercept, standardize=standardize)
    rows = frame.dropna()
    for fit, penalty in zip(fits, penalties):
        assert fit.gap <= 1e-9 and fit.rows == 300 and fit.rounds < 60
        engine = LogisticRegression(
            maxIter=3_000, tol=1e-14, regParam=penalty, elasticNetParam=mixing, standardization=standardize, fitIntercept=intercept
        ).fit(rows)
        assert fit.coefficients == pytest.approx(engine.coefficients.toArray(), abs=2e-4)
        assert fit.intercept == pytest.approx(engine.intercept, abs=2e-4)
        zero = np.abs(fit.coefficients) == 0
        assert np.abs(engine.coefficients.toArray()[zero]).max(initial=0) < 2e-4


def test_folds_equal_separate_fits(frame):
    fold = F.col("key") % 3
    shared = logistic_path.fit_paths(frame, (0.1, 0.01), fold=fold, folds=3)
    assert len(shared) == 8
    for fit in shared[2:]:
        alone = logistic_path.fit_paths(frame.filter(fold != fit.fold), (fit.penalty,))[0]
        assert fit.coefficients == pytest.approx(alone.coefficients, abs=1e-6) and fit.rows == alone.rows
        held = frame.dropna().filter(fold == fit.fold).withColumn("p", logistic_path.probability(frame, alone))
        right = held.agg(F.avg(((F.col("p") > 0.5) == (F.col("label") > 0.5)).cast("double"))).first()[0]
        assert fit.accuracy == pytest.approx(right)


def test_scans_are_shared(frame, monkeypatch):
    scans = []
    plain = logistic_path._sums
    monkeypatch.setattr(logistic_path, "_sums", lambda v, work, size: scans.append(1) or plain(v, work, size))
    logistic_path.fit_paths(frame, (1.0, 0.1, 0.01, 0.001), fold=F.col("key") % 5, folds=5)
    assert len(scans) < 15


def test_sums_added_by_tasks_or_by_the_driver(frame, monkeypatch):
    here = logistic_path.fit_paths(frame, (0.1,))[0]
    monkeypatch.setattr(logistic_path, "FEW_BYTES", 0)
    assert logistic_path.fit_paths(frame, (0.1,))[0].coefficients == pytest.approx(here.coefficients)


def test_search_predicts(frame):
    search = logistic_path.logistic_search(frame, "key")
    assert len(search.fits) == 16 and len(search.accuracy) == 4 and max(search.accuracy.values()) > 0.75
    scored = search.transform(frame.select("key", "label", "features"))
    assert {r["predictionLogReg"] for r in scored.filter("key < 900").collect()} == {0.0, 1.0}
    assert scored.filter("key = 901").first()["predictionLogReg"] is None


def test_separable_rows_one_class_none_and_too_wide(spark, frame):
    apart = spark.createDataFrame([(float(i > 4), Vectors.dense([float(i)])) for i in range(10)], ["label", "features"])
    fit = logistic_path.fit_paths(apart, (0.01,))[0]
    assert fit.gap <= 1e-9 and fit.coefficients[0] > 0
    same = logistic_path.fit_paths(apart.withColumn("label", F.lit(1.0)), (0.01,), intercept=False)[0]
    assert same.gap <= 1e-9
    assert logistic_path.fit_paths(frame.limit(0), (0.1,)) == []
    with pytest.raises(ValueError, match="no rows"):
        logistic_path.logistic_search(frame.limit(0), "key")
    wide = spark.createDataFrame([(1.0, Vectors.sparse(600, {1: 1.0}))], ["label", "features"])
    with pytest.raises(ValueError, match="at most 512"):
        logistic_path.fit_paths(wide, (0.1,))
