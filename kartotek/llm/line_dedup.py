"""Drop lines that many documents share.

Lines leave the documents only as 128-bit hashes with the document's id. Hashes in too few rows go first; of the others
the distinct documents are counted. Texts are shuffled once, to meet the hashes of the lines they lose.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import common
from kartotek.sizing import pinned

# A-Z to a-z, all other bytes as they are
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_KEYS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line without white space at its ends and with A-Z in lower case; None for short lines."""
    key = line.strip(common.SPACE)
    if len(key) < min_chars or common.code_points(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.translate(_LOWER))


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                keys = {line_key(line, min_chars) for line in text.split(b"\n")} - {None}
                found += keys
                ids += [doc] * len(keys)
            both = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
            yield common.batch_of(_KEYS, (pa.array(both[:, 0]), pa.array(both[:, 1]), ids))

    return run


def _reassemble(min_chars: int, as_text: bool):
    kind = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines_of, dropped, kept = [], [], []
            drops = batch.column("drops")
            for i, text in enumerate(common.texts(batch)):
                lines = text.split(b"\n")
                gone = drops[i].as_py()
                stay = lines
                if gone:
                    keys = {np.array([a["k1"], a["k2"]], dtype=np.int64).tobytes() for a in gone}
                    stay = [line for line in lines if line_key(line, min_chars) not in keys]
                text = b"\n".join(stay)
                lines_of.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(text.decode() if as_text else sha256(text).hexdigest())
            yield common.batch_of(schema, (batch.column("doc_id"), lines_of, dropped, kept))

    return run


def _kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, as_text: bool) -> DataFrame:
    rows = common.id_and_text(docs, id_col, text_col)
    keys = rows.mapInArrow(_keys(min_chars), "k1 long, k2 long, doc_id long")
    frequent = pinned(keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).drop("n"))
    found = pinned(keys.join(frequent, ["k1", "k2"]).distinct())
    common_keys = pinned(
        found.groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    lost = (
        found.join(common_keys, ["k1", "k2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.collect_set(F.struct("k1", "k2")).alias("drops"))
    )
    met = rows.join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
    return met.mapInArrow(_reassemble(min_chars, as_text), "doc_id long, n_lines long, n_dropped long, kept string")


def line_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """As :func:`line_dedup`, with the SHA-256 of the text that stays in place of the text."""
    return _kept(docs, id_col, text_col, min_chars, min_docs, False).withColumnRenamed("kept", "kept_sha256")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Per document doc_id, n_lines, n_dropped and the text that stays.

    Lines whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents or more stay only
    in the largest id that holds the key. A null or empty text is one empty line. Rows that share an id are one document
    when documents are counted, and share what they lose; all rows without id are one, smaller than all others. No
    rows give no rows.
    """
    return _kept(docs, id_col, text_col, min_chars, min_docs, True).withColumnRenamed("kept", "text")
