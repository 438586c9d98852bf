"""Exact duplicates by two passes over a Bloom filter.

The first pass marks the bits that at least two texts set. Only texts all of whose bits are marked may have a
partner; they alone are shuffled and grouped by their SHA-256. All others pass straight through.

The filter takes 16 bits a document up to ``max_bits``, which is also the bound of what is broadcast (32 MB by
default). Beyond that bound more texts than needed look repeated, and the exact grouping of their digests
(never of their texts) takes them; results are the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import bloom, common
from kartotek.sizing import pinned

_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("h", pa.int64())]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars, shas, hashes = [], [], []
        for text in common.texts(batch):
            plain = text.translate(None, common.SPACE)
            chars.append(common.code_points(text))
            shas.append(sha256(plain).digest())
            hashes.append(xxhash.xxh3_64_intdigest(plain))
        h = np.array(hashes, dtype=np.uint64).view(np.int64)
        yield common.batch_of(_DIGEST, (batch.column("doc_id"), chars, shas, pa.array(h)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, code points, SHA-256 and a hash of the text without white space."""
    rows = common.id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(_digests, "doc_id long, n_chars long, sha binary, h long")


def _tested(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bloom.contains(shared.value, batch.column("h").to_numpy(zero_copy_only=False))
            yield batch.append_column("maybe", pa.array(hit))

    return run


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without white space; null counts as empty, and empty texts are equal to each
    other. The longest original stays, then the smallest id; a null id only stays when the group has no other.
    Rows that repeat the id of the row that stays, at the same length, are marked kept as well. An empty table
    gives no rows.
    """
    narrow = pinned(digests(docs, id_col, text_col))
    bits = bloom.filter_bits(narrow.count(), max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(narrow.select("h"), bits, twice=True))
    tested = narrow.mapInArrow(
        _tested(shared), "doc_id long, n_chars long, sha binary, h long, maybe boolean"
    ).drop("h")
    maybe = tested.filter("maybe")
    best = pinned(
        maybe.groupBy("sha").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n_chars")).alias("fewest"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"),
        )
    )
    grouped = maybe.join(best, "sha").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.fewest"))).alias("kept"),
        "sha",
    )
    single = tested.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    return single.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """``docs`` without the rows that :func:`decisions` drops; all columns stay as they are."""
    dropped = decisions(docs, id_col, text_col, max_bits).filter(~F.col("kept"))
    return common.without_ids(docs, pinned(dropped.select("doc_id")), id_col)
