from __future__ import annotations


import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from kartotek.functions import dates, scoring, text, vector


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_first_number(spark):
    rows = [("ANTAL_10_19",), ("none",), (None,), ("99999999999",), ("7",)]
    assert values(spark, rows, "c string", text.first_number(F.col("c"))) == [10, None, None, None, 7]


def test_as_text(spark):
    assert values(spark, [(5,), (None,)], "c long", text.as_text(F.col("c"))) == ["5", "None"]


def test_squeezed_lower(spark):
    rows = [(" Opløst  efter\tkonkurs ",), (None,), ("",)]
    assert values(spark, rows, "c string", text.squeezed_lower(F.col("c"))) == ["opløstefterkonkurs", None, ""]


def test_last_status(spark):
    rows = [([("Normal",), ("Under Konkurs",)],), ([],), ([("X",), (None,)],), (None,)]
    got = values(spark, rows, "h array<struct<status:string>>", text.last_status(F.col("h")))
    assert got == ["underkonkurs", "", "", ""]


def test_leading_year(spark):
    rows = [("2010-05-01",), ("1999-31-12",), ("abcd",), (None,), ("12",)]
    assert values(spark, rows, "c string", text.leading_year(F.col("c"))) == [2010, 1999, None, None, 12]


def test_code_to_int(spark):
    rows = [("None",), ("96",), ("x",), (None,)]
    assert values(spark, rows, "c string", text.code_to_int(F.col("c"))) == [100, 96, None, None]


def test_status_label(spark):
    rows = [("aktiv",), ("opløstefterkonkurs",), (None,)]
    assert values(spark, rows, "c string", text.status_label(F.col("c"))) == [0, 1, 1]


def test_array_functions(spark):
    rows = [(["AB", None, "Ø"],), ([],), (None,)]
    assert values(spark, rows, "a array<string>", text.lower_elements(F.col("a"))) == [["ab", None, "ø"], [], None]
    hashed = values(spark, rows, "a array<string>", text.hash_elements(F.col("a")))
    assert hashed[0][1] is None and 0 <= hashed[0][2] < 2**60
    assert values(spark, [(" Hej  med\nDIG ",)], "t string", text.words(F.col("t"))) == [["hej", "med", "dig"]]


def test_whole_days(spark):
    rows = [
        ("2000-01-01", "2000-01-11"),
        ("2000-01-11", "2000-01-01"),
        ("2000-01-01", "2000-01-01"),
        ("2099-12-31", None),
        (None, "2099-12-30"),
        ("not a date", "2000-01-01"),
    ]
    got = values(spark, rows, "a string, b string", dates.whole_days(F.col("a"), F.col("b")))
    assert got == [10, 10, 1, 1, 2, None]


def test_confusion_class(spark):
    nan = float("nan")
    rows = [(0, 0.0), (1, 1.0), (0, 1.0), (1, 0.0), (1, nan), (0, None), (None, 1.0)]
    got = values(spark, rows, "l int, p double", scoring.confusion_class(F.col("l"), F.col("p")))
    assert got == ["TN", "TP", "FP", "FN", "Excluded", "Excluded", "Excluded"]


def test_abs_difference_and_norm(spark):
    rows = [([1.0, 0.0, 1.0], [0.0, 1.0, 0.0]), ([1.0, -2.0], [1.0, 2.0]), (None, [1.0])]
    schema = "a array<double>, b array<double>"
    assert values(spark, rows, schema, vector.abs_difference(F.col("a"), F.col("b"))) == [[1, 1, 1], [0, 4], None]
    assert values(spark, [([3.0, 4.0], [0.0])], schema, vector.norm(F.col("a"))) == [5.0]
    assert values(spark, [([3.0, 4.0], [0.0, 0.0])], schema, vector.squared_distance(F.col("a"), F.col("b"))) == [25.0]
    with pytest.raises(Exception, match="vector sizes differ"):
        values(spark, [([1.0], [1.0, 2.0])], schema, vector.abs_difference(F.col("a"), F.col("b")))


def test_vector_entries(spark):
    data = [(Vectors.sparse(9, {1: 2.0, 7: 0.0}),), (Vectors.dense([0.0, 3.0]),), (Vectors.dense([]),), (Vectors.sparse(2, {}),)]
    frame = spark.createDataFrame(data, ["v"])
    got = [[tuple(e) for e in r[0]] for r in frame.select(vector.vector_entries(F.col("v"))).collect()]
    assert got == [[(1, 2.0)], [(1, 3.0)], [], []]


def test_dense_and_sparse(spark):
    frame = spark.createDataFrame([(Vectors.sparse(3, {1: 2.0}),)], ["v"])
    assert frame.select(vector.dense(F.col("v"))).first()[0] == Vectors.dense([0, 2, 0])
    parts = spark.createDataFrame([(4, [1, 3], [0.5, -1.0]), (2, [], [])], "n int, i array<int>, v array<double>")
    got = [r[0] for r in parts.select(vector.sparse_vector(F.col("n"), F.col("i"), F.col("v"))).collect()]
    assert got == [SparseVector(4, {1: 0.5, 3: -1.0}), SparseVector(2, {})]
    bad = spark.createDataFrame([(4, [1], [0.5, -1.0])], "n int, i array<int>, v array<double>")
    with pytest.raises(Exception, match="lengths mismatch"):
        bad.select(vector.sparse_vector(F.col("n"), F.col("i"), F.col("v"))).collect()
