"""Cosine similarity between the columns of a feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.operators.statistics import as_array
from kartotek.sizing import settled_or_pinned


def column_cosines(frame: DataFrame, features: str, block: int = 2048) -> DataFrame:
    """Cosine of every pair of vector positions over all rows: ``i, j, cosine`` with ``i < j``.

    Each task multiplies its own batches into tables of products and sends only
    those; the tables are added up by position. Work grows with the rows and output
    with the width alone, so a longer table never gives a longer result. Wide
    vectors are done in blocks of ``block`` positions against the rest, each in a pass
    of its own, which bounds a task's table. A position that is zero everywhere has
    cosine null.
    """

    def partial_products(low, high):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            total = None
            for batch in batches:
                rows = batch.column(0).drop_null()
                if len(rows) == 0:
                    continue
                width = len(rows[0])
                values = rows.flatten().to_numpy(zero_copy_only=False)
                if len(values) != len(rows) * width or (total is not None and low + total.shape[1] != width):
                    raise ValueError("vectors of different sizes")
                matrix = values.reshape(len(rows), width)
                product = matrix[:, low:high].T @ matrix[:, low:]
                total = product if total is None else total + product
            if total is not None:
                i, j = np.triu_indices(total.shape[0], m=total.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i + low, pa.int32()), pa.array(j + low, pa.int32()), pa.array(total[i, j], pa.float64())],
                    names=["i", "j", "product"],
                )

        return run

    vectors = frame.select(as_array(frame, features).alias("v"))
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    parts = [
        vectors.mapInArrow(partial_products(low, low + block), "i int, j int, product double")
        for low in range(0, max(width, 1), block)
    ]
    products = reduce(DataFrame.unionByName, parts)
    sums = settled_or_pinned(products.groupBy("i", "j").agg(F.sum("product").alias("product")))
    squares = sums.filter("i = j")
    rows = squares.select("i", F.col("product").alias("__si"))
    columns = squares.select(F.col("i").alias("j"), F.col("product").alias("__sj"))
    pairs = sums.filter("i < j").join(rows, "i").join(columns, "j")
    cosine = F.try_divide(F.col("product"), F.sqrt("__si") * F.sqrt("__sj"))
    return pairs.select("i", "j", cosine.alias("cosine"))
