from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from kartotek.sources import parts
from kartotek.streaming import read_arriving
from kartotek.streaming.groups import GroupStore, keep_up, with_bin

SCHEMA = "kind string, x int, y double, rows long"


def data(start, n):
    return [(None if i % 7 == 0 else "abc"[i % 3], None if i % 5 == 0 else i, i / 4, 2**62) for i in range(start, start + n)]


def expected(frame):
    def stats(c, total):
        x = F.col(c)
        return [F.count(x), F.sum(x.cast(total)), F.sum(x.cast(total)).cast("double") / F.count(x), F.min(x), F.max(x)]

    found = frame.groupBy("kind").agg(
        F.count("*"), *stats("x", "decimal(38,0)"), *stats("y", "double"), *stats("rows", "decimal(38,0)")
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("merge_every", [1, 2, 16])
def test_batches_equal_the_whole(spark, tmp_path, merge_every):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame(data(0, 1), SCHEMA)
    store = GroupStore(str(tmp_path / "store"), rows.schema, ["kind"], ["x", "y", "rows"], merge_every)
    assert store.read(spark).count() == 0
    for i, n in enumerate((40, 3, 25)):
        spark.createDataFrame(data(100 * i, n), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = read_arriving(spark, source, rows.schema, "parquet", files_per_batch=1)
        assert keep_up(stream, store, str(tmp_path / "check"), 120)
        got = sorted((tuple(r) for r in store.read(spark).collect()), key=str)
        assert got == expected(spark.read.parquet(source))
    assert parts.whole_parts(spark, store.folder) == [0, 1, 2]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    batches = [spark.createDataFrame(data(10 * i, 10), SCHEMA) for i in range(5)]
    store = GroupStore(str(tmp_path / "s"), batches[0].schema, ["kind"], ["x"], 2)
    for i, batch in enumerate(batches):
        store.add(batch.limit(4), i)
        store.add(batch, i)
    (tmp_path / "s" / "part=5").mkdir()
    got = store.read(spark)
    assert got.agg(F.sum("n"), F.sum("x_n")).first() == (50, 40)
    assert store._covering([0, 1, 2, 3, 4]) == [3, 4]
    empty = batches[0].limit(0)
    store.add(empty, 5)
    assert store.read(spark).agg(F.sum("n")).first()[0] == 50


def test_with_bin(spark):
    frame = spark.createDataFrame([(0.0,), (1.9,), (2.0,), (-0.1,), (None,), (math.nan,)], "v double")
    assert sorted(r["bin"] for r in with_bin(frame, "v", 0, 2).collect()) == [-1, 0, 0, 1]
