"""What each of several filters removes, in every order in which they may be applied.

A document is a row of a mask matrix: 0 for a filter that it fails, a large number for one that it passes. An order of
the filters is a column of a position matrix, the inverse permutation: the step at which each filter comes. The min-plus
product of the two is the step at which each order removes each document. Documents with equal masks are counted
together first, so the product is over at most 2^k masks a part, whatever the number of documents; their counts are
then scattered over (order, step).

Texts are read once and stay where they are. Only ids, hashes and masks are shuffled, and the only groups gathered
are the counted masks of one part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import common
from kartotek.sizing import pinned

# The filters, the least words, the least share of distinct words, the most share of capitals, the signs
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

WEIGHTS = ("n", "good", "toxic")

_MASKS = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("mask", pa.int32())]
)


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = text.split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * common.code_points(text)) << 2
        | (len(text) != len(text.translate(None, SIGNS))) << 3
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, hashes = [], []
        for text in common.texts(batch):
            masks.append(text_mask(text))
            hashes.append(xxhash.xxh3_128_digest(text))
        both = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
        yield common.batch_of(
            _MASKS, (batch.column("doc_id"), batch.column("part"), pa.array(both[:, 0]), pa.array(both[:, 1]), masks)
        )


def counted_masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """part, mask, n, good and toxic: the documents of each part that fail just the filters of a mask, and their labels.

    A null text is empty, a null part is the empty string. The fifth filter fails a text that a smaller id has too
    (equal by a 128-bit hash); a null id is neither smaller nor larger than any and has no labels. Rows that repeat an id
    count each, and are no copies of each other. Of labels that repeat an id, one that is set is enough.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    narrow = pinned(
        rows.mapInArrow(_masks, "doc_id long, part string, h1 long, h2 long, mask int")
        .groupBy("doc_id", "part", "h1", "h2", "mask")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = narrow.filter("doc_id IS NOT NULL")
    first = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = (
        labels.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")
        )
        .filter("doc_id IS NOT NULL AND (good OR toxic)")
        .groupBy("doc_id")
        .agg(*[F.coalesce(F.max(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")])
    )
    marked = known.join(first, ["h1", "h2", "doc_id"], "left").join(flags, "doc_id", "left")
    copied = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << 4))
    every = marked.select(
        "part", F.col("mask").bitwiseOR(copied).alias("mask"), "n",
        *[(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")],
    ).unionByName(
        narrow.filter("doc_id IS NULL").select(
            "part", "mask", "n", *[F.lit(0).cast("long").alias(c) for c in ("good", "toxic")]
        )
    )
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in WEIGHTS])


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The step (1 to k) at which each order removes what each mask stands for; k + 1 where it stays.

    ``masks`` holds bits, ``orders`` a permutation of the filters a row.
    """
    k = orders.shape[1]
    cost = np.where((masks[:, None] >> np.arange(k)) & 1, 0, k + 1)
    place = np.argsort(orders, axis=1).T + 1
    steps = np.full((len(masks), len(orders)), k + 1)
    for one in range(k):
        np.minimum(steps, cost[:, one, None] + place[one], out=steps)
    return steps


def order_table(counts: pd.DataFrame, filters: Sequence[str], orders: np.ndarray) -> pd.DataFrame:
    """A row per order and step from one part's counted masks (columns mask, n, good and toxic)."""
    k, n_orders = orders.shape[1], len(orders)
    masks = counts["mask"].to_numpy().astype(np.int64)
    n = counts["n"].to_numpy()
    cell = (np.arange(n_orders) * (k + 1))[None, :] + removal_steps(masks, orders) - 1
    removed = {}
    for weight in WEIGHTS:
        sums = np.zeros(n_orders * (k + 1), dtype=np.int64)
        np.add.at(sums, cell, counts[weight].to_numpy()[:, None])
        removed[weight] = sums.reshape(n_orders, k + 1)[:, :k]
    fails = ((masks[:, None] >> np.arange(k)) & 1).astype(np.int64)
    failing, alone = n @ fails, np.array([n[masks == 1 << f].sum() for f in range(k)])
    shapley = np.zeros(k, dtype=np.int64)
    np.add.at(shapley, orders, removed["n"])
    return pd.DataFrame(
        {
            "filter_order": np.repeat(["".join(filters[f] for f in order) for order in orders], k),
            "step": np.tile(np.arange(1, k + 1, dtype=np.int32), n_orders),
            "kept": (n.sum() - removed["n"].cumsum(axis=1)).ravel(),
            "removed": removed["n"].ravel(),
            "redundant": (failing[orders] - removed["n"]).ravel(),
            "unique_fails": alone[orders].ravel(),
            "good_lost": removed["good"].ravel(),
            "toxic_lost": removed["toxic"].ravel(),
            "shapley": shapley[orders].ravel(),
        }
    )


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """For each part and order, a row per step: what the filter removes, what it finds gone already, and what it costs.

    ``counts`` has the columns part, mask (bit i is set where filter i fails), n, good and toxic, and may repeat a mask.
    ``orders`` are strings of filter names, all permutations where none are given; filter names are single letters. No
    rows give no rows.
    """
    numbers = {name: i for i, name in enumerate(filters)}
    table = np.array(
        [[numbers[name] for name in order] for order in orders] if orders else list(permutations(range(len(filters))))
    )
    summed = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in WEIGHTS])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = order_table(part, filters, table)
        found.insert(0, "part", part["part"].iloc[0])
        return found

    return summed.groupBy("part").applyInPandas(
        run,
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long",
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """:func:`audit` of the five filters over the texts of ``docs``, by part and in all 120 orders."""
    return audit(counted_masks(docs, labels, id_col, text_col, part_col))
