"""What the corpus operators share: reading columns of Arrow batches, merging results with whole rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that splits and trims texts
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, as ``doc_id`` long and ``text`` without nulls."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8, one at a time, without a list of the whole batch."""
    values = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    if data is None:
        yield from (b"" for _ in range(len(values)))
        return
    view = memoryview(data)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[start:end])


def code_points(text: bytes) -> int:
    """Number of code points of UTF-8 bytes: all bytes that do not continue one."""
    if text.isascii():
        return len(text)
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``; a null id meets a null id."""
    left, right = docs.alias("docs"), ids.toDF("__id").alias("gone")
    return left.join(right, F.col(f"docs.`{id_col}`").cast("long").eqNullSafe(F.col("gone.__id")), "left_anti")


class Memo(dict):
    """Values worked out when first asked for; emptied when it has grown to its limit."""

    def __init__(self, work, limit: int):
        super().__init__()
        self.work, self.limit = work, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = found = self.work(key)
        return found


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches ordered by ``key`` as tables of about ``rows`` rows that never part a group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            count += held[-1].num_rows
            if count < rows:
                continue
            table_ = pa.Table.from_batches(held).combine_chunks()
            keys = table_.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table_.slice(0, cut)
            held = table_.slice(cut).to_batches()
            count = len(keys) - cut
    if count:
        yield pa.Table.from_batches(held)
