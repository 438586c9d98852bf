"""Text columns as 0/1 or count columns, or as one sparse vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.operators.indexing import term_dictionary
from kartotek.operators.nested import quoted
from kartotek.operators.words import token_vectors
from kartotek.sizing import lookup_join, settle

Values = dict[str, list[str | None]]


def text_columns(frame: DataFrame) -> list[str]:
    """Names of the string columns, in order."""
    return [name for name, kind in frame.dtypes if kind == "string"]


def column_values(frame: DataFrame, columns: list[str], max_width: int = 10_000) -> Values:
    """The distinct values of each column, sorted with null last, from one aggregation.

    They become column names, so they must fit on the driver; more than
    ``max_width`` in all is an error, and :func:`onehot_sparse` is the form to use.
    """
    if not columns:
        return {}
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns]
    )
    found = frame.select(F.inline(pairs)).distinct()
    small = settle(found, max_width)
    if small is None:
        raise ValueError(f"more than {max_width} values; use onehot_sparse")
    values: Values = {c: [] for c in columns}
    for row in small.collect():
        values[row["column"]].append(row["value"])
    return {c: sorted(v, key=lambda x: (x is None, x)) for c, v in values.items()}


def _name(column: str, value: str | None) -> str:
    return f"{column}:{'null' if value is None else value}"


def pivot_onehot(
    frame: DataFrame, column: str, index: str = "Index", values: list[str | None] | None = None
) -> DataFrame:
    """How often each value of ``column`` occurs per index, as columns ``<column>:<value>``; absent is 0.

    Counting is partial before the shuffle, so a frequent index sends one row per map task.
    """
    values = values if values is not None else column_values(frame, [column])[column]
    counts = [
        F.count_if(F.col(quoted(column)).cast("string").eqNullSafe(F.lit(v))).alias(_name(column, v)) for v in values
    ]
    return frame.groupBy(F.col(quoted(index))).agg(*counts)


def onehot_all(
    frame: DataFrame,
    index: str = "Index",
    columns: list[str] | None = None,
    values: Values | None = None,
    unique_index: bool = True,
) -> DataFrame:
    """All text columns as columns ``<column>:<value>``, after the other columns.

    With one row per index, which :func:`row_index` gives, the result is a
    projection: no shuffle and no join. Otherwise one aggregation counts all
    columns per index and is joined back.
    """
    columns = columns if columns is not None else text_columns(frame)
    columns = [c for c in columns if c != index]
    values = values if values is not None else column_values(frame, columns)
    kept = [F.col(quoted(c)) for c in frame.columns if c not in columns]

    def matches(c: str, v: str | None):
        return F.col(quoted(c)).cast("string").eqNullSafe(F.lit(v))

    if unique_index:
        flags = [matches(c, v).cast("long").alias(_name(c, v)) for c in columns for v in values[c]]
        return frame.select(*kept, *flags)
    counts = frame.groupBy(F.col(quoted(index))).agg(
        *[F.count_if(matches(c, v)).alias(_name(c, v)) for c in columns for v in values[c]]
    )
    return lookup_join(frame.select(*kept), counts, [index], "inner")


def onehot_sparse(
    frame: DataFrame,
    index: str = "Index",
    columns: list[str] | None = None,
    dictionary: DataFrame | None = None,
    output: str = "onehot",
    left_out: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """``index`` with one sparse 0/1 vector over all ``<column>:<value>`` terms, and the dictionary used.

    Any number of distinct values will do; each row has a vector of its own, also
    when its index repeats. Terms in ``left_out`` get no position.
    """
    columns = columns if columns is not None else [c for c in text_columns(frame) if c != index]
    parts = [F.concat(F.lit(f"{c}:"), F.coalesce(F.col(quoted(c)).cast("string"), F.lit("null"))) for c in columns]
    found = F.array(*parts)
    if left_out:
        found = F.filter(found, lambda term: ~term.isin(*left_out))
    terms = frame.select(F.col(quoted(index)), found.alias("__terms"))
    dictionary = dictionary if dictionary is not None else term_dictionary(terms, "__terms")
    return token_vectors(terms, [index], "__terms", dictionary, output, binary=True), dictionary
