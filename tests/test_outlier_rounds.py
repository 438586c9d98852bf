from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartotek.plans import outlier_rounds as rounds
from kartotek.sources import parts

SCHEMA = T.StructType(
    [
        T.StructField("cvrNummer", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("features", VectorUDT()),
    ]
)


@pytest.fixture(scope="module")
def layers(spark):
    """Two large groups and, farther and farther out, small ones that a search with few clusters finds one after another."""
    generator = np.random.default_rng(3)
    data = []
    for centre, n in ((0.0, 150), (10.0, 140), (2000.0, 3), (200000.0, 2)):
        for _ in range(n):
            x = generator.normal(centre, 1, 3)
            data.append((len(data), int(x[0] > 5) if len(data) % 9 else int(x[0] <= 5), Vectors.dense(x)))
    return spark.createDataFrame(data, SCHEMA).cache()


SETTINGS = {"ks": (2,), "threshold": 0.02, "inverse_strengths": (0.5,), "folds": 2, "label_folds": 2}


def flags(frame):
    return {r["cvrNummer"]: (r["isOutlier"], r["predictionKmeans"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def whole(layers, tmp_path_factory):
    """An uninterrupted run: its store and its rows."""
    store = str(tmp_path_factory.mktemp("whole") / "s")
    return store, flags(rounds.outlier_rounds(layers, store, **SETTINGS))


def test_rounds_until_none_is_small(spark, whole):
    store, got = whole
    assert len(got) == 295
    assert [got[i][0] for i in (0, 150, 290, 292, 293, 294)] == [0, 0, 2, 2, 1, 1]
    figures = [tuple(r) for r in rounds.round_figures(spark, store).orderBy("round").collect()]
    assert [f[:4] for f in figures] == [(1, 2, 295, 2), (2, 2, 293, 3), (3, 2, 290, 0)]
    assert all(f[4] in (58, 59) and 0.8 < f[5] / f[4] <= 1 for f in figures)
    last = [got[i][1] for i in range(290)]
    assert len(set(last[:150])) == 1 and len(set(last[150:])) == 1 and last[0] != last[150]


@pytest.mark.parametrize("broken", ["rows", "figures"])
def test_restart_gives_the_same(spark, layers, whole, tmp_path, monkeypatch, broken):
    store = str(tmp_path / "cut")
    real, calls = parts.write_part, []

    def failing(frame, folder, number):
        calls.append(number)
        if number == 2 and folder.endswith(broken):
            if broken == "rows":
                frame.limit(7).write.mode("overwrite").parquet(parts.part_path(folder, number))
            raise RuntimeError("killed")
        real(frame, folder, number)

    monkeypatch.setattr(rounds, "write_part", failing)
    with pytest.raises(RuntimeError, match="killed"):
        rounds.outlier_rounds(layers, store, **SETTINGS)
    assert rounds.round_figures(spark, store).count() == 1
    monkeypatch.setattr(rounds, "write_part", lambda *a: (calls.append(("again", a[2])), real(*a))[1])
    spread = layers.repartition(5)
    assert flags(rounds.outlier_rounds(spread, store, **SETTINGS)) == whole[1]
    assert ("again", 1) not in calls
    before = len(calls)
    assert flags(rounds.outlier_rounds(spread, store, **SETTINGS)) == whole[1]
    assert len(calls) == before


def test_rounds_of_odd_tables(spark, layers, tmp_path):
    none = rounds.outlier_rounds(layers.limit(0), str(tmp_path / "e"), **SETTINGS)
    assert none.count() == 0 and none.columns == ["cvrNummer", "label", "features", "predictionKmeans", "isOutlier"]
    empty = spark.createDataFrame([(1000, 1, None)], SCHEMA)
    got = flags(rounds.outlier_rounds(layers.unionByName(empty), str(tmp_path / "n"), max_rounds=1, **SETTINGS))
    assert got[1000] == (0, None) and got[294][0] == 1
    one_label = layers.withColumn("label", F.lit(1))
    store = str(tmp_path / "l")
    assert rounds.outlier_rounds(one_label, store, max_rounds=1, **SETTINGS).count() == 295
    assert [(r["tested"], r["right"]) for r in rounds.round_figures(spark, store).collect()] == [(0, 0)]
    with pytest.raises(TypeError, match="not a vector"):
        rounds.outlier_rounds(layers.withColumn("features", F.lit(1)), store)


def test_parts(spark, tmp_path):
    folder = str(tmp_path / "p")
    assert parts.whole_parts(spark, folder) == []
    for n in (10, 2):
        parts.write_part(spark.range(n), folder, n)
    (tmp_path / "p" / "part=3").mkdir()
    assert parts.whole_parts(spark, folder) == [2, 10]
    assert parts.read_parts(spark, folder, [2, 10], "id long").count() == 12
    assert parts.read_parts(spark, folder, [], "id long").count() == 0
