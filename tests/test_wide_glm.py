from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from kartotek.operators import regression, wide_glm


@pytest.fixture(scope="module")
def frame(spark):
    generator = np.random.default_rng(6)
    x = np.column_stack([generator.normal(0, 1, (400, 3)), generator.random(400) < 0.2])
    p = 1 / (1 + np.exp(-(x @ np.array([1.0, -1.5, 0.0, 0.7]) - 0.3)))
    y = generator.random(400) < p
    data = [(float(y[i]), Vectors.dense(x[i]) if i % 2 else Vectors.sparse(4, {j: v for j, v in enumerate(x[i]) if v})) for i in range(400)]
    return spark.createDataFrame([*data, (None, data[0][1]), (1.0, None)], ["label", "features"]).repartition(4)


def test_few_columns_as_the_engine_fits_them(frame):
    fit = wide_glm.fit_wide_binomial(frame)
    engine = regression.fit_binomial(frame.dropna())
    assert fit.gap <= 1e-8 and fit.rows == 400
    assert fit.coefficients == pytest.approx(engine.coefficients.toArray(), abs=1e-6)
    assert fit.intercept == pytest.approx(engine.intercept, abs=1e-6)
    assert fit.deviance == pytest.approx(engine.summary.deviance, rel=1e-9)
    errors = wide_glm.standard_errors(frame, fit, [0, 1, 2, 3])
    assert errors == pytest.approx(engine.summary.coefficientStandardErrors, rel=1e-5)


def test_errors_of_a_table_of_two_by_two(spark):
    """The closed form: the log odds ratio, and the root of the sum of the inverse counts."""
    counts = {(0, 0): 40, (0, 1): 15, (1, 0): 12, (1, 1): 33}
    data = [(float(y), Vectors.sparse(1, {0: float(x)} if x else {})) for (x, y), n in counts.items() for _ in range(n)]
    frame = spark.createDataFrame(data, ["label", "features"])
    fit = wide_glm.fit_wide_binomial(frame)
    assert fit.coefficients[0] == pytest.approx(math.log(33 * 40 / (12 * 15)), abs=1e-7)
    slope, intercept = wide_glm.standard_errors(frame, fit, [0])
    assert slope == pytest.approx(math.sqrt(sum(1 / n for n in counts.values())), rel=1e-6)
    assert intercept == pytest.approx(math.sqrt(1 / 40 + 1 / 15), rel=1e-6)


def test_twenty_thousand_columns(spark):
    """One column a group next to a shared one; a group's own share of ones fixes its coefficient."""
    width, data = 20_000, []
    for group in range(0, width, 4):
        ones = 1 + group % 3
        data += [(float(i < ones), Vectors.sparse(width, {group: 1.0})) for i in range(4)]
    data += [(float(i % 2), Vectors.sparse(width, {})) for i in range(100)]
    frame = spark.createDataFrame(data, ["label", "features"]).repartition(4)
    fit = wide_glm.fit_wide_binomial(frame, tolerance=1e-7)
    assert fit.intercept == pytest.approx(0.0, abs=1e-2) and fit.gap <= 1e-7
    for group in (0, 4, 8, 19_996):
        ones = 1 + group % 3
        assert fit.coefficients[group] == pytest.approx(math.log(ones / (4 - ones)), abs=2e-2)
    assert (fit.coefficients[1::4] == 0).all()


def test_no_rows_and_wrong_type(spark, frame):
    with pytest.raises(ValueError, match="no rows"):
        wide_glm.fit_wide_binomial(frame.limit(0))
    with pytest.raises(TypeError):
        wide_glm.fit_wide_binomial(spark.createDataFrame([(1.0, [1.0])], ["label", "features"]))


def test_own_positions_stay_in_their_tasks(spark, monkeypatch):
    """Rows with one position of their own next to shared ones: the same fit without a product of vectors as wide as the table."""
    generator = np.random.default_rng(11)
    monkeypatch.setattr(wide_glm, "SHARED", 3)
    data = []
    for i in range(1_500):
        group, kind = int(generator.integers(0, 60)), int(generator.integers(0, 3))
        entries = {kind: 1.0, 3 + group: float(1 + group % 2)} if i % 10 else {kind: 1.0}
        data.append((float(generator.random() < (0.2 + 0.2 * kind + 0.1 * (group % 4))), Vectors.sparse(63, entries)))
    frame = spark.createDataFrame(data, ["label", "features"]).repartition(5)
    with monkeypatch.context() as m:
        m.setattr(wide_glm, "_fit_shared", lambda *_: None)
        plain = wide_glm.fit_wide_binomial(frame)
    monkeypatch.setattr(wide_glm, "_products", None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fit = wide_glm.fit_wide_binomial(frame)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert fit.gap <= 1e-8 and (fit.rows, plain.rows) == (1_500, 1_500)
    assert fit.deviance == pytest.approx(plain.deviance, rel=1e-9)
    chances = [[f.intercept + v.dot(f.coefficients) for _, v in data] for f in (fit, plain)]
    assert chances[0] == pytest.approx(chances[1], abs=1e-4)


def test_rows_with_several_rare_positions(spark, frame, monkeypatch):
    whole = wide_glm.fit_wide_binomial(frame)
    monkeypatch.setattr(wide_glm, "SHARED", 1)
    some = wide_glm.fit_wide_binomial(frame)
    assert some.coefficients == pytest.approx(whole.coefficients, abs=1e-6) and some.deviance == pytest.approx(whole.deviance, rel=1e-9)
