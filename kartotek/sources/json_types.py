"""A schema for JSON lines found in the data, kept from one batch of files to the next, and the lines that are no records.

The types of all lines are joined by an aggregate, partial on the map side. The join of two types is associative and
commutative, so neither the order of lines nor that of files has a say: a missing or null value takes the other
type, whole numbers and fractions give ``double``, structs join field by field and arrays element by element, and
whatever does not fit together becomes ``string``, which holds the JSON text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A quoted name, which is left alone, or the word that variant types use for a struct.
_OBJECT = re.compile(r"(`(?:[^`]|``)*`)|\bOBJECT<")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file: ``file, line``; blank lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.filter(F.length(F.trim("line")) > 0)


def _is_record(line: Column) -> Column:
    """Whether the line is one well-formed JSON object and nothing more, without a repeated name at any level.

    Spark's parser stops after the first value and does not look at the rest. So the line is read inside brackets and
    inside braces: what follows the object can close one of them, but not both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"k":'), line, F.lit("}")))
    return F.coalesce(F.schema_of_variant(listed).startswith("ARRAY<OBJECT<") & named.isNotNull(), F.lit(False))


def bad_lines(lines: DataFrame) -> DataFrame:
    """The lines that are no JSON object, with their file and text."""
    return lines.filter(~_is_record(F.col("line")))


def _plain(kind: T.DataType) -> T.DataType:
    """A variant's type in terms of columns: exact decimals are double, and what has several types is text."""
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, _plain(f.dataType)) for f in kind.fields]
        return T.StructType(sorted(fields, key=lambda f: f.name))
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, (T.DecimalType, T.FloatType)):
        return T.DoubleType()
    if isinstance(kind, T.VariantType):
        return T.StringType()
    return kind


def joined_types(one: T.DataType, other: T.DataType) -> T.DataType:
    """The least type that holds both."""
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return other
    if isinstance(one, T.StructType) and isinstance(other, T.StructType):
        held = {f.name: f.dataType for f in one.fields}
        for field in other.fields:
            held[field.name] = joined_types(held.get(field.name, T.NullType()), field.dataType)
        return T.StructType([T.StructField(name, held[name]) for name in sorted(held)])
    if isinstance(one, T.ArrayType) and isinstance(other, T.ArrayType):
        return T.ArrayType(joined_types(one.elementType, other.elementType))
    if {type(one), type(other)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.StringType()


def found_schema(lines: DataFrame, known: T.StructType | None = None) -> T.StructType:
    """The schema of all records among ``lines``, joined with that of earlier batches; one scan, one value to the driver.

    A field that was never anything but null has the type ``void``; :func:`readable` makes it text. No
    records give ``known``, or no fields.
    """
    value = F.try_parse_json("line")
    records = lines.filter(_is_record(F.col("line")))
    text = records.agg(F.schema_of_variant_agg(value).alias("kind")).first()["kind"]
    known = known or T.StructType([])
    if text in (None, "VOID"):
        return known
    kind = T.DataType.fromDDL(_OBJECT.sub(lambda m: m[1] or "STRUCT<", text))
    return joined_types(known, _plain(kind))


def readable(kind: T.DataType) -> T.DataType:
    """The same type with text in place of ``void`` and of structs without fields, which files cannot hold."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, readable(f.dataType)) for f in kind.fields]) if kind.fields else T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(readable(kind.elementType))
    return T.StringType() if isinstance(kind, T.NullType) else kind


def records(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The records among ``lines`` as columns of ``schema``; a line that is none gives no row.

    A text column holds a string as it is and any other value as its JSON text. A
    value that does not fit its column, which cannot be for a schema found on the same lines, is null.
    """
    good = lines.filter(_is_record(F.col("line")))
    return good.select(F.from_json("line", readable(schema)).alias("__r")).select("__r.*")


def save_schema(spark: SparkSession, schema: T.StructType, path: str) -> None:
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_schema(spark: SparkSession, path: str) -> T.StructType:
    import json

    return T.StructType.fromJson(json.loads(spark.read.text(path).first()["value"]))


def schema_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """One row per field at any level: ``path, kind``; the path of an array's element ends in ``[]``."""

    def walk(kind: T.DataType, path: str) -> list[tuple[str, str]]:
        if isinstance(kind, T.StructType):
            own = [(path, "struct")] if path else []
            return reduce(list.__add__, [walk(f.dataType, f"{path}.{f.name}" if path else f.name) for f in kind.fields], own)
        if isinstance(kind, T.ArrayType):
            return [(path, "array"), *walk(kind.elementType, f"{path}[]")]
        return [(path, kind.simpleString())]

    return spark.createDataFrame(walk(schema, ""), "path string, kind string")
