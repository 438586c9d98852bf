from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.sql import functions as F

from kartotek import sizing
from kartotek.operators import histograms, ranking, similarity, statistics, vectors


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture(scope="module")
def points():
    generator = np.random.default_rng(3)
    return [(i, i % 3, [float(x) for x in generator.normal(i % 3, 1, 4)]) for i in range(90)]


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame(points, "id int, g int, v array<double>")


def test_counts(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 3), (None, 5), ("b", None)], "k string, n int")
    assert rows(statistics.row_count(frame)) == [(4,)]
    assert set(rows(statistics.group_count(frame, ["k"]))) == {("a", 2), (None, 1), ("b", 1)}
    assert set(rows(statistics.group_average(frame, ["k"], "n"))) == {("a", 2.0), (None, 5.0), ("b", None)}
    assert rows(statistics.global_min(frame, "n")) == [(1,)] and rows(statistics.global_sum(frame, "n")) == [(9,)]
    assert rows(statistics.distinct_count(frame, ["k"])) == [(3,)]


def test_describe(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "k string, n int")
    got = {r[0]: r[1:] for r in rows(statistics.describe_columns(frame, ["n"], ["k"]))}
    assert got["a"] == ("n", 2, 2.0, pytest.approx(math.sqrt(2)), 1.0, 3.0)
    assert got["b"] == ("n", 0, None, None, None, None)


def test_vector_stats(spark, points, table):
    matrix = np.array([p[2] for p in points])
    got = statistics.vector_stats(table, "v").first()
    assert got["n"] == 90
    assert got["mean"] == pytest.approx(matrix.mean(axis=0)) and got["variance"] == pytest.approx(matrix.var(axis=0, ddof=1))
    assert got["total"] == pytest.approx(matrix.sum(axis=0)) and got["maximum"] == pytest.approx(matrix.max(axis=0))
    sparse = spark.createDataFrame([(Vectors.sparse(2, {0: 3.0}),), (Vectors.dense([1, 5]),)], ["v"])
    assert rows(statistics.vector_total(sparse, "v")) == [([4.0, 5.0],)]


def brute_f(points):
    matrix = np.array([p[2] for p in points])
    groups = np.array([p[1] for p in points])
    names = sorted(set(groups))
    between = sum(
        (groups == g).sum() * ((matrix[groups == g].mean(axis=0) - matrix.mean(axis=0)) ** 2).sum() for g in names
    ) / (len(names) - 1)
    within = sum(((matrix[groups == g] - matrix[groups == g].mean(axis=0)) ** 2).sum() for g in names)
    return between / (within / (len(points) - len(names)))


def test_f_statistic(table, points):
    got = statistics.f_statistic(table, "g", "v").first()
    assert got["f"] == pytest.approx(brute_f(points)) and (got["n_groups"], got["n_rows"]) == (3, 90)
    shifted = table.withColumn("v", F.transform("v", lambda x: x + 1e4))
    assert statistics.f_statistic(shifted, "g", "v").first()["f"] == pytest.approx(brute_f(points), rel=1e-6)


def test_f_statistic_beyond_the_small_limit(table, points, monkeypatch):
    monkeypatch.setattr(sizing, "SMALL_NESTED_ROWS", 1)
    assert statistics.f_statistic(table, "g", "v").first()["f"] == pytest.approx(brute_f(points))


def test_group_means_joined(spark):
    frame = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [3.0, 4.0]), (3, "b", None)], "id int, g string, v array<double>")
    got = sorted(rows(statistics.with_group_means(frame, "g", "v").select("id", "group_mean")))
    assert got == [(1, [2.0, 3.0]), (2, [2.0, 3.0]), (3, None)]
    assert rows(statistics.with_norm(frame.filter("id = 2"), "v").select("norm")) == [(5.0,)]


def test_histogram(spark):
    data = [("a", float(x)) for x in range(101)] + [("b", 4.0), ("b", 4.0), ("c", None)]
    frame = spark.createDataFrame(data, "k string, x double")
    got = rows(histograms.histogram(frame, "x", ["k"]))
    a = [r for r in sorted(got) if r[0] == "a"]
    counts, edges = np.histogram(np.arange(101.0), 50, density=False)
    assert [r[4] for r in a] == list(counts)
    assert [r[5] for r in a] == pytest.approx(np.histogram(np.arange(101.0), 50, density=True)[0])
    assert [r[2] for r in a] == pytest.approx(edges[:-1])
    b = [r for r in sorted(got) if r[0] == "b"]
    assert len(b) == 50 and b[0][4] == 2 and sum(r[4] for r in b) == 2 and b[0][5] is None
    assert not [r for r in got if r[0] == "c"]
    whole = sorted(rows(histograms.histogram(frame.filter("k = 'a'"), "x")))
    assert [r[3] for r in whole] == list(counts)


def test_weighted_histogram(spark):
    data = [("a", 1.0, 3), ("a", 2.5, 1), ("a", 9.0, 2), ("b", 4.0, 5), ("c", 7.0, 1)]
    counted = spark.createDataFrame(data, "k string, x double, n long")
    plain = counted.select("k", F.explode(F.array_repeat("x", F.col("n").cast("int"))).alias("x"))
    a, b = histograms.group_bounds(counted, "x", ["k"], "n"), histograms.group_bounds(plain, "x", ["k"])
    for left, right in zip(sorted(rows(a)), sorted(rows(b))):
        assert left[:2] == right[:2] and left[2:3] + left[4:] == pytest.approx(right[2:3] + right[4:])
        assert (left[3] is None and right[3] is None) or left[3] == pytest.approx(right[3], abs=1e-9)
    a, b = histograms.histogram(counted, "x", ["k"], weight="n"), histograms.histogram(plain, "x", ["k"])
    assert sorted(rows(a), key=str) == sorted(rows(b), key=str)
    a, b = histograms.histogram(counted, "x", weight="n"), histograms.histogram(plain, "x")
    assert sorted(rows(a)) == sorted(rows(b))


def test_log_histogram(spark):
    data = [0.5, 1.0, 2.0, 50.0, 123.4, 99999.0, 1e8, 2e8]
    frame = spark.createDataFrame([(x,) for x in data], "x double")
    counts, edges = np.histogram(data, np.logspace(0, 8, 100))
    got = sorted(rows(histograms.log_histogram(frame, "x")))
    assert [r[3] for r in got] == list(counts) and [r[1] for r in got] == pytest.approx(edges[:-1])


def test_normal_fit(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, x double")
    got = sorted(rows(histograms.normal_fit(histograms.group_bounds(frame, "x", ["k"]), ["k"])))
    a = [r for r in got if r[0] == "a"]
    assert len(a) == 51 and a[25][2] == pytest.approx(2.0)
    assert a[25][3] == pytest.approx(1 / (math.sqrt(2) * math.sqrt(2 * math.pi)))
    assert all(r[3] is None for r in got if r[0] == "b")


def test_column_cosines(spark, table, points):
    matrix = np.array([p[2] for p in points])
    unit = matrix / np.linalg.norm(matrix, axis=0)
    got = {r[:2]: r[2] for r in rows(similarity.column_cosines(table.repartition(5), "v"))}
    assert len(got) == 6
    assert all(c == pytest.approx((unit[:, i] * unit[:, j]).sum()) for (i, j), c in got.items())
    flat = spark.createDataFrame([([0.0, 1.0],), ([0.0, 2.0],), (None,)], "v array<double>")
    assert rows(similarity.column_cosines(flat, "v")) == [(0, 1, None)]
    for block in (1, 3):
        again = {r[:2]: r[2] for r in rows(similarity.column_cosines(table.repartition(5), "v", block=block))}
        assert again == pytest.approx(got)


def test_histogram_leaves_nan_out_and_weights_large_values(spark):
    data = [(x, n) for x, n in ((1e9, 1), (1e9 + 1, 1), (1e9 + 2, 1), (float("nan"), 5), (None, 2))]
    frame = spark.createDataFrame(data, "x double, n long")
    for weight in (None, "n"):
        bounds = rows(histograms.group_bounds(frame, "x", [], weight))
        assert bounds == [(3, 1e9 + 1, 1.0, 1e9, 1e9 + 2)]
        counts = [r[3] for r in sorted(rows(histograms.histogram(frame, "x", bins=2, weight=weight)))]
        assert counts == [1, 2]
    grouped = frame.withColumn("g", F.lit("a"))
    assert rows(histograms.group_bounds(grouped, "x", ["g"], "n")) == [("a", 3, 1e9 + 1, 1.0, 1e9, 1e9 + 2)]


def test_ranking(spark):
    data = [(i, i % 2, float(i % 5)) for i in range(20)]
    frame = spark.createDataFrame(data, "id int, g int, x double")
    assert [r[0] for r in rows(ranking.top_rows(frame, "x", "id", 3))] == [4, 9, 14]
    top = ranking.top_per_group(frame, "g", "x", "id", 2)
    assert sorted((r["g"], r["rank"], r["id"]) for r in top.collect()) == [(0, 1, 4), (0, 2, 14), (1, 1, 9), (1, 2, 19)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [False, True])
def test_max_step(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(sizing, "SMALL_ROWS", 1)
    scores = spark.createDataFrame([(2, -10.0), (4, -6.0), (3, -9.0), (5, -2.0)], "k int, score double")
    assert rows(ranking.max_step(scores)) == [(5, 4.0)]
    ties = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 6.0)], "k int, score double")
    assert rows(ranking.max_step(ties)) == [(2, 3.0)]
    assert rows(ranking.max_step(ties.filter("k = 1"))) == []


def test_assemble_and_scale(spark):
    frame = spark.createDataFrame([(1, 2.0, 5.0), (3, 4.0, 5.0)], "`a:x.y` int, b double, c double")
    assembled = vectors.assemble(frame, ["b", "a:x.y", "c"])
    assert [list(r["features"]) for r in assembled.collect()] == [[2, 1, 5], [4, 3, 5]]
    assert assembled.columns == ["a:x.y", "b", "c", "features"]
    scaled, _ = vectors.scale(assembled)
    sd = math.sqrt(2)
    assert [list(r["scaledfeatures"]) for r in scaled.collect()] == [
        pytest.approx([2 / sd, 1 / sd, 0]),
        pytest.approx([4 / sd, 3 / sd, 0]),
    ]
    with pytest.raises(Exception):
        vectors.assemble(frame.withColumn("b", F.lit(None).cast("double")), ["b"]).collect()


def test_abs_difference_forms(spark):
    data = [(Vectors.sparse(3, {0: 1.0, 2: 1.0}), Vectors.sparse(3, {1: 1.0})), (Vectors.dense([1, 0, -2]), Vectors.dense([0, 0, 2]))]
    frame = spark.createDataFrame(data, ["a", "b"])
    got = [r["difference"] for r in vectors.with_abs_difference(frame, "a", "b").collect()]
    assert got == [[1, 1, 1], [1, 0, 4]]


def test_dense_stage(spark, tmp_path):
    frame = spark.createDataFrame([(1.0, 0.0)], ["a", "b"])
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="v"), vectors.DenseVectors(inputCol="v", outputCol="d")]
    model = Pipeline(stages=stages).fit(frame)
    model.write().overwrite().save(str(tmp_path / "p"))
    got = PipelineModel.load(str(tmp_path / "p")).transform(frame).first()
    assert got["d"] == Vectors.dense([1, 0]) and type(got["d"]).__name__ == "DenseVector"


def test_vector_kinds(spark):
    old = spark.createDataFrame([(OldVectors.dense([1, 2]),)], ["v"])
    assert vectors.vector_kind(old.schema, "v") == "mllib"
    new = vectors.to_ml_vectors(old, "v")
    assert vectors.vector_kind(new.schema, "v") == "ml" and new.first()["v"] == Vectors.dense([1, 2])
    with pytest.raises(ValueError):
        vectors.vector_kind(new.schema, "gone")
    with pytest.raises(TypeError):
        vectors.vector_kind(spark.range(1).schema, "id")
