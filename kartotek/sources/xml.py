"""XML tables and XBRL reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
BOOK_SCHEMA = (
    "_id string, author string, title string, genre string, price double, publish_date date, description string"
)
XBRL_PARTS = ("context", "unit", "schemaRef")
ROWS_PER_FILE = 50_000


def read_xml(
    spark: SparkSession,
    path: str,
    row_tag: str,
    schema: T.StructType | str | None = None,
    one_per_line: bool = False,
) -> DataFrame:
    """One row per ``row_tag`` element; an attribute ``a`` becomes the column ``_a``.

    With ``one_per_line`` every line is a document of its own, and big files are
    read in several splits; otherwise a file is one document and one task reads it.
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("multiLine", not one_per_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_xml(frame: DataFrame, path: str, row_tag: str, root_tag: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One ``row_tag`` element per row; columns starting with ``_`` become attributes.

    A file is one document that one task reads as a whole, so none has more than ``rows_per_file`` rows.
    """
    writer = frame.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag)
    writer.option("maxRecordsPerFile", rows_per_file).save(path)


def read_xbrl(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, one_per_line: bool = False
) -> DataFrame:
    """One row per ``xbrl`` report with its contexts, units and facts; all leaves are text.

    A folder of reports has one per file, or one per line with ``one_per_line``.
    """
    reader = spark.read.format("xml").option("rowTag", "xbrl").option("inferSchema", False)
    reader = reader.option("multiLine", not one_per_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def _as_array(frame: DataFrame, name: str):
    column = F.col(f"`{name}`")
    if isinstance(frame.schema[name].dataType, T.ArrayType):
        return column
    return F.when(column.isNotNull(), F.array(column))


def _part(struct_type: T.StructType, value, *path: str):
    """A nested text field, whatever prefix its elements have, or null when the schema has no such field."""
    for name in path:
        held = struct_type.names if isinstance(struct_type, T.StructType) else []
        found = next((n for n in held if n.split(":")[-1] == name), None)
        if found is None:
            return F.lit(None).cast("string")
        value, struct_type = value.getField(found), struct_type[found].dataType
    return value.cast("string")


def _fact_rows(name: str, kind: T.StructType, values):
    """One fact element's occurrences in a report as an array of a common struct; empty when absent."""

    def fact(value):
        return F.struct(
            F.lit(name).alias("name"),
            _part(kind, value, "_contextRef").alias("contextRef"),
            _part(kind, value, "_unitRef").alias("unitRef"),
            _part(kind, value, "_precision").alias("precision"),
            _part(kind, value, "_decimals").alias("decimals"),
            _part(kind, value, "_VALUE").alias("value"),
        )

    return F.transform(F.coalesce(values, F.array()), fact)


def xbrl_facts(reports: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per fact, with the period and identifier of its context and the measure of its unit.

    Everything needed is inside the report, so contexts and units are looked up in
    the row and nothing is shuffled. A fact that occurs once is a struct and one
    that occurs for several contexts an array of structs; both become rows.
    """
    keep = keep or []

    def local(name: str) -> str:
        return name.split(":")[-1]

    facts = []
    for field in reports.schema.fields:
        kind = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType
        if field.name.startswith("_") or field.name in keep or local(field.name) in XBRL_PARTS:
            continue
        if not isinstance(kind, T.StructType) or "_contextRef" not in kind.names:
            continue
        facts.append(_fact_rows(field.name, kind, _as_array(reports, field.name)))
    if not facts:
        raise ValueError("the reports hold no fact with a contextRef")

    def one_of(part: str):
        names = [n for n in reports.columns if local(n) == part]
        if not names:
            raise ValueError(f"the reports have no {part} element")
        kind = reports.schema[names[0]].dataType
        return _as_array(reports, names[0]), (kind.elementType if isinstance(kind, T.ArrayType) else kind)

    contexts, context_type = one_of("context")
    has_units = any(local(n) == "unit" for n in reports.columns)
    units, unit_type = one_of("unit") if has_units else (F.array(), T.StructType())
    rows = reports.select(
        *[F.col(f"`{c}`") for c in keep],
        contexts.alias("__contexts"),
        units.alias("__units"),
        F.explode(F.concat(*facts)).alias("__fact"),
    )
    context = F.try_element_at(F.filter("__contexts", lambda c: c["_id"] == F.col("__fact.contextRef")), F.lit(1))
    chosen = rows.withColumn("__context", context)
    if has_units:
        unit = F.try_element_at(F.filter("__units", lambda u: u["_id"] == F.col("__fact.unitRef")), F.lit(1))
        chosen = chosen.withColumn("__unit", unit)
        measure = _part(unit_type, F.col("__unit"), "measure")
    else:
        measure = F.lit(None).cast("string")
    context_col = F.col("__context")
    return chosen.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__fact.name").alias("name"),
        F.col("__fact.contextRef").alias("context_ref"),
        _part(context_type, context_col, "entity", "identifier", "_VALUE").alias("identifier"),
        _part(context_type, context_col, "period", "startDate").try_cast("date").alias("start_date"),
        _part(context_type, context_col, "period", "endDate").try_cast("date").alias("end_date"),
        _part(context_type, context_col, "period", "instant").try_cast("date").alias("instant"),
        F.col("__fact.unitRef").alias("unit_ref"),
        measure.alias("measure"),
        F.col("__fact.precision").alias("precision"),
        F.col("__fact.decimals").alias("decimals"),
        F.col("__fact.value").alias("value"),
        F.when(F.col("__fact.unitRef").isNotNull(), F.col("__fact.value").try_cast("double")).alias("number"),
    )
