from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kartotek.operators import cleaning, nested, sampling

ENVELOPE = "_type string, _source struct<Vrvirksomhed:struct<cvrNummer:long>,Vrdeltagerperson:struct<enhed:long>>"


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture
def deep(spark):
    data = [
        (1, (("a", [("x", 1), ("y", 2)]),)),
        (2, (("b", []),)),
        (3, (("c", None),)),
        (4, None),
    ]
    return spark.createDataFrame(data, "id int, m struct<inner:struct<name:string,items:array<struct<k:string,n:int>>>>")


def test_project_paths(deep):
    got = rows(nested.project_paths(deep, [("m.inner.name", "name"), ("m.inner.items.k", "ks")]))
    assert got == [("a", ["x", "y"]), ("b", []), ("c", None), (None, None)]
    got = nested.project_paths(deep, [("id", "id"), ("m.inner.gone", "gone")], missing_as_null=True)
    assert rows(got) == [(1, None), (2, None), (3, None), (4, None)]
    assert nested.has_path(deep.schema, "m.inner.items.n") and not nested.has_path(deep.schema, "m.items")


def test_split_by_type(spark):
    data = [("virksomhed", ((1,), None)), ("deltager", (None, (2,))), ("ukendt", (None, None)), (None, ((3,), None))]
    frame = spark.createDataFrame(data, ENVELOPE)
    parts = nested.split_by_type(
        frame, {"virksomhed": ("Vrvirksomhed", "virksomhed"), "deltager": ("Vrdeltagerperson", "deltager")}
    )
    assert rows(parts["virksomhed"].select("virksomhed.cvrNummer")) == [(1,)]
    assert rows(parts["deltager"].select("deltager.enhed")) == [(2,)]


def test_struct_fields(deep):
    assert nested.struct_fields(deep.schema, "m") == nested.struct_fields(deep.schema, 1) == ["inner"]
    assert nested.struct_fields(deep.select("m.inner").schema, "inner", "type")[0] == "string"
    with pytest.raises(TypeError):
        nested.struct_fields(deep.schema, "id")


def test_next_layer(deep):
    layer = nested.next_layer(deep, ["name"], "items", "m", "inner")
    assert layer.columns == ["name", "k", "n"]
    assert rows(layer) == [("a", "x", 1), ("a", "y", 2)]
    assert len(rows(nested.next_layer(deep, ["name"], "items", "m", "inner", keep_empty=True))) == 5
    flat = deep.select("id", "m.inner.items")
    assert rows(nested.next_layer(flat, ["id"], "items")) == [(1, "x", 1), (1, "y", 2)]


def test_expand_struct(deep):
    wide = nested.expand_struct(deep, "m", "not_there")
    assert wide.columns == ["id", "m_inner"]
    wide = nested.expand_struct(wide, "m_inner")
    assert wide.columns == ["id", "m_inner_name", "m_inner_items"]
    with pytest.raises(ValueError):
        nested.expand_struct(deep, "")


def test_explode_and_list(spark, deep):
    flat = deep.select("id", "m.inner.items")
    assert len(rows(nested.explode_rows(flat, "items"))) == 2
    assert len(rows(nested.explode_rows(flat, "items", "item", keep_empty=True))) == 5
    frame = spark.createDataFrame([(1, None, "x")], "a int, `b.c` string, `d:e` string")
    assert rows(nested.columns_to_list(frame)) == [(["1", None, "x"],)]


def test_filters(spark):
    frame = spark.createDataFrame([("F", 1), ("O", None), (None, None)], "s string, n int")
    assert rows(cleaning.keep_values(frame, "s", ["F", "O"])) == [("F", 1), ("O", None)]
    assert rows(cleaning.where_all_null(frame, ["s", "n"])) == [(None, None)]
    assert rows(cleaning.where_present(frame, ["s", "n"])) == [("F", 1)]
    assert rows(cleaning.drop_missing(frame)) == [("F", 1)]
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert rows(cleaning.drop_missing(nan)) == [(1.0,)]


def test_columns(spark):
    frame = spark.createDataFrame([(1, "2", True)], "a int, `b.c` string, d boolean")
    assert cleaning.without(frame, ["a", "zzz"]).columns == ["b.c", "d"]
    assert cleaning.prefixed(frame, "p:", keep=["a"]).columns == ["a", "p:b.c", "p:d"]
    cast = cleaning.cast_columns(frame, {"b.c": "int", "d": "int", "a": "long"})
    assert rows(cast) == [(1, 2, 1)]
    years = spark.createDataFrame([(2010,), (None,)], "stiftelsesAar int")
    assert rows(cleaning.with_offset_year(years)) == [(2010, 10), (None, None)]


def test_fills(spark):
    frame = spark.createDataFrame([("a", 1), (None, None)], "t string, n int")
    assert rows(cleaning.fill_text(frame, ["t", "gone"])) == [("a", 1), ("ukendt", None)]
    assert rows(cleaning.fill_zero(frame)) == [("a", 1), (None, 0)]


def test_impute_mean(spark):
    data = [(1, 1, None, "x"), (2, None, None, None), (3, 2, None, "y"), (4, 2, None, "z")]
    frame = spark.createDataFrame(data, "id int, `a:b.c` int, none double, t string")
    got = rows(cleaning.impute_mean(frame, ["a:b.c", "none"]))
    assert got[1] == (2, pytest.approx(5 / 3), None, None)
    assert [r[0] for r in got] == [1, 2, 3, 4]


def test_status_durations(spark):
    data = [
        (1, ["2000-01-01", "2000-01-11"], ["2000-01-11", None], ["Normal", "Konkurs"]),
        (2, ["2000-01-05"], ["2000-01-01"], ["Normal"]),
        (3, ["2000-01-05"], ["2000-01-05"], ["Normal"]),
    ]
    frame = spark.createDataFrame(data, "cvr long, gyldigFra array<string>, gyldigTil array<string>, status array<string>")
    got = sorted(rows(cleaning.status_durations(frame)))
    assert got == [(1, "Normal", 3), (4, "Normal", 2), (10, "Normal", 1), (36515, "Konkurs", 1)]


def test_union_and_flags(spark):
    a = spark.createDataFrame([(1, 0), (2, 3)], "id int, isOutlier int")
    kept, flagged = sampling.split_by_flag(a, "isOutlier")
    assert rows(kept) == [(1, 0)] and rows(flagged) == [(2, 3)]
    b = spark.createDataFrame([(1, "x")], "id int, t string")
    assert sorted(rows(sampling.union_rows(a, b, b)), key=str) == [(1, 0, None), (1, None, "x"), (1, None, "x"), (2, 3, None)]


def test_keep_members(spark):
    frame = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    members = spark.createDataFrame([(2,), (2,), (None,), (9,)], "k int")
    assert rows(sampling.keep_members(frame, members, "k")) == [(2,), (2,)]


def test_samples(spark):
    frame = spark.range(1000).withColumn("t", F.col("id") % 2)
    assert 50 < sampling.sample_rows(frame, 0.1).count() < 150
    got = sampling.sample_by(frame, "t", {0: 1.0})
    assert got.count() == 500
    assert rows(sampling.sample_rows(frame, 0.1)) == rows(sampling.sample_rows(frame, 0.1))


def test_stratified_split(spark):
    frame = spark.range(1003).select(
        F.col("id"), F.when(F.col("id") < 3, None).when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label")
    )
    for size in (10_000, 1):
        split = sampling.stratified_split(frame, "label", "id", bucket_rows=size)
        got = {tuple(r) for r in split.groupBy("label", "is_test").count().collect()}
        n1 = frame.filter("label = 1").count()
        n0 = frame.filter("label = 0").count()
        t1, t0 = int(n1 * 0.2 + 0.5), int(n0 * 0.2 + 0.5)
        assert got == {(1, True, t1), (1, False, n1 - t1), (0, True, t0), (0, False, n0 - t0), (None, True, 1), (None, False, 2)}
        assert split.select("id").distinct().count() == 1003
    one = set(rows(sampling.stratified_split(frame, "label", "id", bucket_rows=10_000)))
    five = set(rows(sampling.stratified_split(frame, "label", "id", bucket_rows=1)))
    assert one == five
    assert five != set(rows(sampling.stratified_split(frame, "label", "id", seed="other")))
    tiny = spark.createDataFrame([(1, 0), (2, 0)], "id int, label int")
    assert rows(sampling.stratified_split(tiny, "label", "id").filter("is_test")) == []
