"""What may be broadcast, and where intermediate tables are written.

Nothing in the library broadcasts a side on trust. A side that is expected to be
small (group statistics, centres, dictionaries) goes through :func:`settle`,
which runs it once and measures it under a row and byte limit. Above the limit the join is an
ordinary shuffle join. Keys with many rows are found by a count first; their rows are spread over as
many salts as the count asks for, and only their lookup rows are repeated.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, UserDefinedType

SMALL_ROWS = 100_000
SMALL_NESTED_ROWS = 10_000
SMALL_BYTES = 64 << 20
SALTS = 16
HOT_ROWS = 4_000_000

_MADE: list[str] = []


def _only_as_rows(kind: DataType) -> bool:
    """Types that do not go through Arrow unchanged from Python values."""
    return isinstance(kind, UserDefinedType) or "timestamp" in kind.simpleString()


def _nested(kind: DataType) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType, UserDefinedType))


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes, worked out where the row is."""
    if isinstance(kind, UserDefinedType):
        value, kind = F.unwrap_udt(value), kind.sqlType()
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(value) + 8
    elif isinstance(kind, ArrayType):
        inner = kind.elementType
        if _nested(inner) or isinstance(inner, (StringType, BinaryType)):
            each = F.transform(value, lambda x: value_bytes(x, inner))
            size = F.aggregate(each, F.lit(8).cast("long"), lambda total, n: total + n)
        else:
            size = F.size(value) * 8 + 8
    elif isinstance(kind, MapType):
        keys = value_bytes(F.map_keys(value), ArrayType(kind.keyType))
        size = keys + value_bytes(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        size = reduce(
            lambda x, y: x + y, [value_bytes(value.getField(f.name), f.dataType) for f in kind.fields], F.lit(8)
        )
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def settle(frame: DataFrame, max_rows: int | None = None, max_bytes: int = SMALL_BYTES) -> DataFrame | None:
    """``frame`` as a local table of known size, or None when it is not small.

    Rows and their bytes are counted where they are, over at most ``max_rows + 1`` rows, and only a table within
    both limits is collected; frames with arrays, structs or vectors have a lower limit of rows than flat ones.
    """
    schema = frame.schema
    if max_rows is None:
        max_rows = SMALL_NESTED_ROWS if any(_nested(f.dataType) for f in schema.fields) else SMALL_ROWS
    few = frame.limit(max_rows + 1).persist()
    try:
        sizes = [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields]
        width = reduce(lambda x, y: x + y, sizes, F.lit(0).cast("long"))
        rows_in, bytes_in = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
        if rows_in > max_rows or bytes_in > max_bytes:
            return None
        rows = few.collect()
    finally:
        few.unpersist()
    session = frame.sparkSession
    if not rows or any(_only_as_rows(field.dataType) for field in schema.fields):
        return session.createDataFrame(rows, schema)
    table = pa.Table.from_pylist([row.asDict(recursive=True) for row in rows], schema=to_arrow_schema(schema))
    return session.createDataFrame(table, schema)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup``, whose key ``on`` is unique; a null key matches a null key.

    The lookup is broadcast only when :func:`settle` proves it small. Otherwise each fact row gets a salt below the
    number of copies of its key, and the lookup is repeated so often: once for most keys, and once per ``HOT_ROWS``
    rows for those with more (:func:`hot_keys`), so no key is handled by a single task. The salt comes from the row's
    partition and values: equal rows of different partitions differ in it, and a task that runs again gives the same.
    """
    renamed = lookup.withColumnsRenamed({k: f"__{k}" for k in on})
    matches = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in on])
    extra = [F.col(f"`__{k}`") for k in on]
    small = settle(renamed, max_rows)
    if small is not None:
        return facts.join(F.broadcast(small), matches, how).drop(*extra)
    hot = settle(hot_keys(facts, on))
    hashed = [F.col(f"`{c}`") for c, kind in facts.dtypes if "map<" not in kind]
    spread = F.spark_partition_id() + F.xxhash64(*hashed)
    if hot is None:
        # More hot keys than may be broadcast: every key gets the same number of copies
        facts, copies = facts.withColumn("__salt", F.pmod(spread, F.lit(SALTS))), F.lit(SALTS)
    elif hot.isEmpty():
        facts, copies = facts.withColumn("__salt", F.pmod(spread, F.lit(1))), F.lit(1)
    else:
        facts = _with_copies(facts, hot, {k: k for k in on}).withColumn("__salt", F.pmod(spread, F.col("__copies")))
        facts = facts.drop("__copies")
        renamed, copies = _with_copies(renamed, hot, {k: f"__{k}" for k in on}), F.col("__copies")
    repeated = renamed.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), (copies - 1).cast("long"))))
    joined = facts.join(repeated.drop("__copies"), matches & (F.col("__salt") == F.col("__copy")), how)
    return joined.drop(*extra).drop("__salt", "__copy")


def hot_keys(facts: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """Keys with more than ``rows`` (``HOT_ROWS``) rows, and how many tasks of so many rows they need, as ``__copies``.

    There is at most one for each ``rows`` rows. Counts are partial before they are shuffled.
    """
    limit = HOT_ROWS if rows is None else rows
    counted = facts.groupBy(*[F.col(f"`{k}`") for k in on]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    return counted.select(*[F.col(f"`{k}`") for k in on], F.ceil(F.col("__n") / limit).cast("long").alias("__copies"))


def _with_copies(frame: DataFrame, hot: DataFrame, names: dict[str, str]) -> DataFrame:
    """``frame`` with ``__copies`` of its key in the columns ``names``, 1 for keys that are not hot."""
    marked = hot.withColumnsRenamed({k: f"__hot_{k}" for k in names})
    same = [F.col(f"`{own}`").eqNullSafe(F.col(f"`__hot_{k}`")) for k, own in names.items()]
    joined = frame.join(F.broadcast(marked), reduce(lambda a, b: a & b, same), "left")
    return joined.drop(*[F.col(f"`__hot_{k}`") for k in names]).withColumn("__copies", F.coalesce("__copies", F.lit(1).cast("long")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="kartotek-")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def pinned(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder as Parquet and read back.

    Later uses see the very same rows, also after the loss of executors, and read
    only the columns they need.
    """
    path = scratch_path(frame.sparkSession, "pinned")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; :func:`clean_up` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clean_up(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables of this process from the shared folder, or those made since ``made_so_far()``."""
    context = spark.sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    for path in _MADE[since:]:
        place = path_of(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    del _MADE[since:]


def made_so_far() -> int:
    """A mark for :func:`clean_up`."""
    return len(_MADE)


def settled_or_pinned(frame: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``frame`` computed once: a local table when small, else written to the shared folder."""
    small = settle(frame, max_rows)
    return small if small is not None else pinned(frame)
