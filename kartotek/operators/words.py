"""Word counts and bags of words."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartotek.functions.text import words
from kartotek.functions.vector import sparse_vector
from kartotek.operators.nested import elements, quoted
from kartotek.operators.term_hash import counted_numbers, term_hash
from kartotek.sizing import lookup_join, pinned


def word_count(frame: DataFrame, text_col: str) -> DataFrame:
    """How often each lower-cased word occurs in the whole table: ``word, n``."""
    found = elements(frame, words(F.col(quoted(text_col))), "word")
    return found.groupBy("word").agg(F.count("*").alias("n"))


def token_counts(frame: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """How often each token occurs in each row: ``<id>, term, n``; one row per id.

    A row holds all its tokens, so they are counted where they are, a batch of rows
    at a time, and nothing is shuffled.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids, tokens = batch.column(0), batch.column(1)
            rows = pc.list_parent_indices(tokens).to_numpy().astype("int64")
            terms = pc.list_flatten(tokens).dictionary_encode()
            present = terms.indices.is_valid().to_numpy(zero_copy_only=False)
            codes = terms.indices.drop_null().to_numpy()
            width = max(len(terms.dictionary), 1)
            pairs, n = np.unique(rows[present] * width + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(pairs // width)), terms.dictionary.take(pa.array(pairs % width)), pa.array(n, pa.int64())],
                names=[id_col, "term", "n"],
            )

    chosen = frame.select(F.col(quoted(id_col)), F.col(quoted(tokens_col)))
    schema = T.StructType(
        [chosen.schema[id_col], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
    )
    return chosen.mapInArrow(count, schema)


def bag_of_words(
    frame: DataFrame, id_col: str, tokens_col: str, dictionary: DataFrame, unknown: str = "drop"
) -> DataFrame:
    """Count of each dictionary term per row: ``<id>, term_index, n``.

    ``dictionary`` has ``term`` and ``term_index``, and an id belongs to one row. A token it lacks is dropped, or an error
    with ``unknown="error"``. Rows meet a dictionary of bounded size, numbered 0, 1, 2, ..., where they are; any other
    is joined to the counted tokens of each row.
    """
    terms = term_hash(dictionary, strict=False)
    if terms is None:
        return _joined_bag(frame, id_col, tokens_col, dictionary, unknown)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            rows, numbers, n = counted_numbers(batch.column(1), terms, unknown)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(numbers), pa.array(n, pa.int64())], names=[id_col, "term_index", "n"]
            )

    chosen = frame.select(F.col(quoted(id_col)), F.col(quoted(tokens_col)))
    schema = T.StructType([chosen.schema[id_col], T.StructField("term_index", T.LongType()), T.StructField("n", T.LongType())])
    found = chosen.mapInArrow(count, schema)
    return found.withColumn("term_index", F.col("term_index").cast(dictionary.schema["term_index"].dataType))


def _joined_bag(frame: DataFrame, id_col: str, tokens_col: str, dictionary: DataFrame, unknown: str) -> DataFrame:
    """As :func:`bag_of_words` for a dictionary of any size, by a join."""
    counts = token_counts(frame, id_col, tokens_col)
    found = lookup_join(counts, dictionary.select("term", "term_index"), ["term"], "left" if unknown == "error" else "inner")
    at = F.col("term_index")
    if unknown == "error":
        at = F.when(at.isNotNull(), at).otherwise(F.raise_error(F.concat(F.lit("term not in the dictionary: "), F.col("term"))))
    return found.select(F.col(quoted(id_col)), at.alias("term_index"), "n")


def numbered_size(dictionary: DataFrame) -> int:
    """How many terms a dictionary has; an error unless they are numbered 0, 1, 2, ... without gap or repeat."""
    index = F.col("term_index")
    n, low, high, distinct = dictionary.agg(
        F.count("*"), F.min(index), F.max(index), F.count_distinct(index)
    ).first()
    if n and (low, high, distinct) != (0, n - 1, n):
        raise ValueError(f"{n} terms numbered {low} to {high} with {distinct} different numbers")
    return n


def token_vectors(
    frame: DataFrame, keep: list[str], tokens_col: str, dictionary: DataFrame, output: str, binary: bool = False
) -> DataFrame:
    """The columns ``keep`` of every row with a sparse vector of its dictionary terms, however many terms there are.

    Each row is a row of its own, also when its other columns repeat; a null array
    gives an empty vector, and tokens the dictionary lacks are dropped. With a dictionary of bounded size this is a
    projection: the rows stay where they are. With a larger one they get a number when they are written, their counted
    terms meet the dictionary by join, and come together again by that number.
    """
    terms = term_hash(dictionary)
    if terms is None:
        return _joined_vectors(frame, keep, tokens_col, dictionary, output, binary)

    def assemble(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, numbers, n = counted_numbers(batch.column(len(keep)), terms)
            many = batch.num_rows
            offsets = pa.array(np.searchsorted(rows, np.arange(many + 1)).astype(np.int32))
            vector = pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(many, np.int8)), pa.array(np.full(many, terms.size, np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.ones(len(n)) if binary else n.astype(float))),
                ],
                names=["type", "size", "indices", "values"],
            )
            held = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*held, vector], names=[*[f"__k{i}" for i in range(len(keep))], "__vector"])

    rows = frame.select(*[F.col(quoted(c)).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(quoted(tokens_col)).alias("__tokens"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__vector", VectorUDT())])
    return rows.mapInArrow(assemble, schema).toDF(*keep, output)


def _joined_vectors(
    frame: DataFrame, keep: list[str], tokens_col: str, dictionary: DataFrame, output: str, binary: bool
) -> DataFrame:
    """As :func:`token_vectors` for a dictionary of any size, by a join and a grouping of its entries."""
    size = numbered_size(dictionary)
    columns = [F.col(quoted(c)).alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = pinned(
        frame.select(*columns, F.col(quoted(tokens_col)).alias("__tokens")).withColumn(
            "__row", F.monotonically_increasing_id()
        )
    )
    held = [f"__k{i}" for i in range(len(keep))]
    counts = lookup_join(
        token_counts(rows, "__row", "__tokens"), dictionary.select("term", "term_index"), ["term"], "inner"
    )
    value = F.lit(1.0) if binary else F.col("n").cast("double")
    entry = F.struct(F.col("term_index").cast("long").alias("at"), value.alias("value"))
    none = F.lit(None).cast("struct<at:bigint,value:double>")
    found = counts.select("__row", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in held], entry.alias("__e"))
    every = rows.select("__row", *held, none.alias("__e")).unionByName(found)
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in held]
    together = every.groupBy("__row").agg(*firsts, F.sort_array(F.collect_list("__e")).alias("__entries"))
    vector = sparse_vector(F.lit(size), F.col("__entries.at"), F.col("__entries.value"))
    return together.select(*[F.col(h).alias(c) for h, c in zip(held, keep)], vector.alias(output))


def bag_of_words_vectors(
    frame: DataFrame, id_col: str, tokens_col: str, dictionary: DataFrame, output: str = "features"
) -> DataFrame:
    """``<id>`` with a sparse count vector as long as the dictionary, one per row; unknown tokens are dropped.

    The dictionary must be numbered 0, 1, 2, ... as :func:`term_dictionary` does.
    """
    return token_vectors(frame, [id_col], tokens_col, dictionary, output)
