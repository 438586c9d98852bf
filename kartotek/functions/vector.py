"""Expressions on ``array<double>`` columns, and changes of form to and from ML vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_doubles(values: Column) -> Column:
    """A numeric array as ``array<double>``."""
    return values.cast("array<double>")


def dense(vector: Column) -> Column:
    """An ML vector, sparse or dense, as a dense ML vector."""
    return array_to_vector(vector_to_array(vector))


def same_size(a: Column, b: Column) -> Column:
    """``a``, with an error at run time when the two arrays differ in length."""
    problem = F.format_string("vector sizes differ: %d and %d", F.size(a), F.size(b))
    return F.when(F.size(a) == F.size(b), a).when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(problem))


def abs_difference(a: Column, b: Column) -> Column:
    """Element-wise absolute difference of two arrays of equal size."""
    return F.zip_with(same_size(a, b), b, lambda x, y: F.abs(x - y))


def norm(values: Column) -> Column:
    """L2 norm of an array."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of equal size."""
    squares = F.zip_with(same_size(a, b), b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    """An ML sparse vector from its parts; an error when indices and values differ in number.

    ``indices`` must be ascending. The vector type has no cast from a struct, so
    the parts pass through its JSON form, all on the JVM side.
    """
    problem = F.format_string("the lengths mismatch: %d, %d", F.size(indices), F.size(values))
    checked = F.when(F.size(indices) == F.size(values), values).otherwise(F.raise_error(problem))
    parts = F.struct(
        F.lit(0).alias("type"),
        size.cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"),
        checked.cast("array<double>").alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema).getField("v")


def vector_entries(vector: Column) -> Column:
    """The non-zero entries of an ML vector as an array of ``index, value``; a sparse one is not widened."""
    parts = F.unwrap_udt(vector)
    values = parts.getField("values")
    places = F.when(parts.getField("type") == 0, parts.getField("indices")).otherwise(
        F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    )
    entries = F.arrays_zip(places.alias("index"), values.alias("value"))
    return F.filter(entries, lambda e: e["value"] != 0)


def vector_distance(vector: Column, centre: Column) -> Column:
    """Distance of an ML vector to an array of the same size; a sparse vector is not widened.

    Of a sparse one, the centre's square is corrected at the stored positions.
    """
    parts = F.unwrap_udt(vector)
    values, places, size = parts.getField("values"), parts.getField("indices"), parts.getField("size")
    problem = F.format_string("vector sizes differ: %d and %d", size, F.size(centre))
    stored = (
        F.when(size == F.size(centre), F.arrays_zip(places.alias("at"), values.alias("x")))
        .when(size.isNull() | centre.isNull(), None)
        .otherwise(F.raise_error(problem))
    )

    def more(e):
        c = F.get(centre, e["at"])
        return (e["x"] - c) * (e["x"] - c) - c * c

    square = F.aggregate(centre, F.lit(0.0), lambda total, c: total + c * c)
    sparse = F.aggregate(stored, square, lambda total, e: total + more(e))
    return F.when(parts.getField("type") == 1, norm(abs_difference(values, centre))).otherwise(
        F.when(sparse.isNotNull(), F.sqrt(F.greatest(sparse, F.lit(0.0))))
    )
