"""Nested structs and arrays: projection, one layer down, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name safe to use where dots and colons have a meaning."""
    return "`" + name.replace("`", "``") + "`"


def path_column(path: str) -> Column:
    """The column at a dotted path; every part is quoted."""
    return F.col(".".join(quoted(part) for part in path.split(".")))


def has_path(schema: T.DataType, path: str) -> bool:
    """Whether a dotted path exists in a schema; arrays of structs are looked through."""
    for part in path.split("."):
        while isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if not isinstance(schema, T.StructType) or part not in schema.names:
            return False
        schema = schema[part].dataType
    return True


def optional_path(frame: DataFrame, path: str, kind: str = "string") -> Column:
    """The column at a dotted path, or a null of type ``kind`` when the schema lacks it."""
    return path_column(path) if has_path(frame.schema, path) else F.lit(None).cast(kind)


def project_paths(frame: DataFrame, paths: list[tuple[str, str]], missing_as_null: bool = False) -> DataFrame:
    """Select dotted paths under new names.

    A null struct gives a null leaf, and a path through an array of structs gives
    the array of that field. With ``missing_as_null`` a path that an inferred
    schema lacks becomes a null text column instead of an error.
    """
    at = (lambda path: optional_path(frame, path)) if missing_as_null else path_column
    return frame.select(*[at(path).alias(alias) for path, alias in paths])


def split_by_type(
    frame: DataFrame, payloads: dict[str, tuple[str, str]], type_col: str = "_type", source_col: str = "_source"
) -> dict[str, DataFrame]:
    """One frame per document type, holding that type's payload struct.

    ``payloads`` maps a type to its field below ``source_col`` and the new column
    name. On a store partitioned by ``type_col`` each filter reads only its own files.
    """
    return {
        kind: frame.filter(F.col(type_col) == kind).select(path_column(f"{source_col}.{field}").alias(alias))
        for kind, (field, alias) in payloads.items()
    }


def elements(frame: DataFrame, values: Column, name: str, keep: list[str] | None = None) -> DataFrame:
    """One row per non-null element of a computed array, next to the columns in ``keep``.

    A plain explode makes Spark test the array for emptiness first and so work it
    out twice; the outer form with the nulls filtered afterwards works it out once.
    """
    kept = [F.col(quoted(c)) for c in keep or []]
    return frame.select(*kept, F.explode_outer(values).alias(name)).filter(F.col(quoted(name)).isNotNull())


def struct_fields(schema: T.StructType, column: str | int, attribute: str = "name") -> list:
    """Names of the fields of a struct column, or another attribute of them such as ``type``."""
    kind = schema[column].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"{column} is not a struct but {kind.simpleString()}")
    return [field.jsonValue()[attribute] for field in kind.fields]


def explode_rows(frame: DataFrame, column: str, alias: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per array element in place of the array; a null or empty array drops the row unless kept."""
    generator = F.explode_outer if keep_empty else F.explode
    others = [F.col(quoted(c)) for c in frame.columns if c != column]
    return frame.select(*others, generator(path_column(column)).alias(alias or column))


def next_layer(
    frame: DataFrame, static: list[str], exploded: str, *prefix: str, keep_empty: bool = False
) -> DataFrame:
    """Open an array of structs: ``static`` columns repeat, and each element's fields become columns.

    All names are looked up below the struct path given by ``prefix``.
    """
    lead = "".join(f"{part}." for part in prefix)
    generator = F.explode_outer if keep_empty else F.explode
    rows = frame.select(
        *[path_column(lead + c).alias(c) for c in static], generator(path_column(lead + exploded)).alias(exploded)
    )
    fields = struct_fields(rows.schema, exploded)
    return rows.select(
        *[F.col(quoted(c)) for c in static],
        *[F.col(f"{quoted(exploded)}.{quoted(f)}").alias(f) for f in fields],
    )


def expand_struct(frame: DataFrame, column: str, *more: str) -> DataFrame:
    """Flatten struct columns to ``<column>_<field>``, after all other columns in their order.

    Extra names that the frame does not have are ignored.
    """
    if column == "":
        raise ValueError("the column name is empty")
    chosen = [column, *[c for c in more if c in frame.columns]]
    kept = [F.col(quoted(c)) for c in frame.columns if c not in chosen]
    fields = [
        F.col(f"{quoted(c)}.{quoted(f)}").alias(f"{c}_{f}") for c in chosen for f in struct_fields(frame.schema, c)
    ]
    return frame.select(*kept, *fields)


def columns_to_list(frame: DataFrame, name: str = "featlist", columns: list[str] | None = None) -> DataFrame:
    """A single array column with the text of every column, in column order; nulls stay."""
    return frame.select(F.array(*[F.col(quoted(c)).cast("string") for c in columns or frame.columns]).alias(name))
