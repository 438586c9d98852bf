"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's target is its share of all words by weight, but never over ``max_repeats`` times its size. Whole passes
over a source need no choice. What is left of the targets is dealt out in blocks of equal size: first to the
sources by highest quotients, then within each source to its shards by the same rule. A shard lays its documents in a ring in
seeded order, cut into blocks from a seeded word on, and takes the first blocks up to its quota, so that nearly all
documents stay whole. Only the block that closes the ring can be shorter than the others.

A shard holds a bounded number of words and documents whatever the size of its source, and is the only thing
that is gathered in one task. The shards of a source are never gathered: the divisor that gives them their source's blocks is
found by counting, many divisors to an aggregate, and ties are settled by shard number in the same way. Only one row a source
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import common
from kartotek.sizing import pinned

# Weights of the sources in their order, repeating
WEIGHTS = (5, 2, 1)

BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SHARD_DOCS = 4_096
MAX_REPEATS = 3
SEED = 42
CANDIDATES = 48

_SIZES = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("h", pa.int64())]
)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, hashes = [], []
        for text in common.texts(batch):
            found.append(len(text.split()))
            hashes.append(xxhash.xxh3_64_intdigest(text))
        h = pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))
        columns = (batch.column("row"), batch.column("doc_id"), batch.column("source").cast(pa.string()), found, h)
        yield common.batch_of(_SIZES, columns)


def sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None
) -> DataFrame:
    """A number of each row, doc_id, source, the number of words of the text and a hash of it."""
    rows = docs.select(
        (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_count, "row long, doc_id long, source string, size long, h long")


def targets(totals: list[int], weights: list[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the sum of ``totals`` by weight; none over ``max_repeats`` times its own total, the excess is shared anew."""
    size, weight = np.array(totals, dtype=float), np.array(weights, dtype=float)
    cap, out, free = size * max_repeats, np.zeros(len(size)), np.ones(len(size), dtype=bool)
    left = float(size.sum())
    while free.any():
        share = np.where(free, left * weight / weight[free].sum(), 0.0)
        over = free & (share > cap)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap[over]
        left -= float(cap[over].sum())
        free &= ~over
    return out.tolist()


def apportion(votes, seats: int, limits) -> np.ndarray:
    """Sainte-Laguë: ``seats`` go one by one to the highest ``votes / (2 * won + 1)``; ties go to the earlier party.

    No party wins more than its limit or, without votes, anything. A divisor found by bisection gives nearly all
    seats at once, so the work does not depend on their number.
    """
    votes, limits = np.asarray(votes, dtype=float), np.asarray(limits, dtype=np.int64)
    limits = np.where(votes > 0, limits, 0)
    seats = min(int(seats), int(limits.sum()))

    def won(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), limits)

    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    low, high = float(votes[votes > 0].min()) / (2.0 * int(limits.max()) + 4), float(votes.max()) * 4
    for _ in range(128):
        middle = (low + high) / 2
        if won(middle).sum() > seats:
            low = middle
        else:
            high = middle
    quota = won(high)
    while quota.sum() < seats:
        quotient = np.where(quota < limits, votes / (2 * quota + 1), -1.0)
        quota[int(np.argmax(quotient))] += 1
    return quota


def _won(divisor, block_words: int):
    """Blocks that a shard wins under a divisor; none over what it holds."""
    return F.least(F.floor(F.col("words") / divisor + 0.5), F.ceil(F.col("words") / block_words))


def _per_source(shards: DataFrame, values: dict[int, list[float]], measures) -> dict[int, list[int]]:
    """Sums over the shards of each source of what ``measures`` makes of the source's values."""
    table = shards.sparkSession.createDataFrame(list(values.items()), "no int, at array<double>")
    n = len(next(iter(values.values())))
    sums = [F.sum(measures(F.col("at")[i])).alias(f"s{i}") for i in range(n)]
    rows = shards.join(F.broadcast(table), F.col("source_no") == F.col("no")).groupBy("source_no").agg(*sums).collect()
    return {r["source_no"]: [int(r[f"s{i}"]) for i in range(n)] for r in rows}


def shard_quotas(shards: DataFrame, seats: dict[int, int], block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_no, shard and quota: how many of its source's ``seats`` (blocks) each shard gets, by Sainte-Laguë.

    ``shards`` has source_no, shard and words and is read several times. A shard gets no more blocks than it holds and, among
    equal quotients, the smaller number comes first. What is broadcast and collected has one row a source.
    """
    held = {
        r["source_no"]: r
        for r in shards.groupBy("source_no").agg(
            F.sum(F.ceil(F.col("words") / block_words)).alias("limit"), F.max("words").alias("most"), F.max("shard").alias("last")
        ).collect()
    }
    # The divisor of each source lies in (low, high]: low gives too many blocks, high not too many
    low, high, need, given = {}, {}, {}, {}
    for no, r in held.items():
        need[no] = min(seats.get(no, 0), r["limit"])
        low[no], high[no], given[no] = 1.0, 4.0 * r["most"] + 1.0, 0
        if need[no] == r["limit"]:
            high[no], given[no] = 1.0, r["limit"]

    def narrow(no: int) -> bool:
        return given[no] == need[no] or np.nextafter(low[no], high[no]) >= high[no]

    while open_ := [no for no in held if not narrow(no)]:
        tried = {no: np.linspace(low[no], high[no], CANDIDATES + 2)[1:-1].tolist() for no in open_}
        if min(high[no] / low[no] for no in open_) > 2:
            tried = {no: np.geomspace(low[no], high[no], CANDIDATES + 2)[1:-1].tolist() for no in open_}
        for no, sums in _per_source(shards, tried, lambda d: _won(d, block_words)).items():
            over = [d for d, won in zip(tried[no], sums) if won > need[no]]
            under = [(d, won) for d, won in zip(tried[no], sums) if won <= need[no]]
            low[no] = max([low[no], *over])
            if under:
                high[no], given[no] = min(under)
    # Shards that are equal at the divisor: as many as are needed, by number
    most = {no: float(held[no]["last"]) if given[no] < need[no] else -1.0 for no in held}
    least = {no: -1.0 for no in held}
    while open_ := [no for no in held if given[no] < need[no] and most[no] - least[no] > 1]:
        tried = {no: np.unique(np.floor(np.linspace(least[no], most[no], CANDIDATES + 2)))[1:-1].tolist() for no in open_}
        tried = {no: (t or [least[no]]) + [most[no]] * (CANDIDATES - max(len(t), 1)) for no, t in tried.items()}
        bounds = shards.sparkSession.createDataFrame([(no, low[no], high[no]) for no in open_], "b int, low double, high double")
        tied = shards.join(F.broadcast(bounds), F.col("source_no") == F.col("b")).filter(
            _won(F.col("low"), block_words) > _won(F.col("high"), block_words)
        )
        for no, sums in _per_source(tied, tried, lambda t: (F.col("shard") <= t).cast("long")).items():
            enough = [t for t, n in zip(tried[no], sums) if n >= need[no] - given[no]]
            few = [t for t, n in zip(tried[no], sums) if n < need[no] - given[no]]
            most[no], least[no] = min([most[no], *enough]), max([least[no], *few])
    rows = [(no, low[no], high[no], most[no]) for no in held]
    table = shards.sparkSession.createDataFrame(rows, "no int, low double, high double, last double")
    base = _won(F.col("high"), block_words)
    more = (F.col("shard") <= F.col("last")) & (_won(F.col("low"), block_words) > base)
    found = shards.join(F.broadcast(table), F.col("source_no") == F.col("no"))
    return found.select("source_no", "shard", (base + more.cast("long")).cast("long").alias("quota"))


def _mixed(values: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit integers."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PICKED = "row long, doc_id long, source string, size long, source_size long, target double, passes long, a1 long, b1 long, a2 long, b2 long"


def _select_blocks(block_words: int, seed: int):
    """Per document, word ranges [a1, b1) and [a2, b2) of the blocks that its shard takes."""

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["rank", "doc_id", "size", "h", "row"], kind="stable", na_position="last")
        size = docs["size"].to_numpy()
        end = np.cumsum(size)
        start, length = end - size, int(end[-1])
        take = min(int(docs["quota"].iloc[0]) * block_words, length)
        place = np.array([(seed << 40) ^ (int(docs["source_no"].iloc[0]) << 20) ^ int(docs["shard"].iloc[0])])
        first = int(_mixed(place)[0] % np.uint64(max(length, 1)))
        ranges = [(first, min(first + take, length)), (0, max(0, first + take - length))]
        for n, (low, high) in enumerate(ranges, 1):
            a, b = np.clip(start, low, high) - start, np.clip(end, low, high) - start
            docs[f"a{n}"], docs[f"b{n}"] = np.where(b > a, a, 0), np.where(b > a, b, 0)
        return docs[["row", "doc_id", "source", "size", "source_size", "target", "passes", "a1", "b1", "a2", "b2"]]

    return run


def plan(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED,
    max_repeats: int = MAX_REPEATS, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS, **columns: str,
) -> DataFrame:
    """What the mix takes of each document: its columns are those of ``_PICKED``, and taken.

    A document is taken ``passes`` times whole and once more over the word ranges [a1, b1) and [a2, b2). Sources
    are ordered by code point, null last, and get the weights in turn. A null text has no words; documents without
    words are taken 0 words. Rows that repeat an id are documents of their own. No rows give no rows.
    """
    session = docs.sparkSession
    narrow = pinned(sizes(docs, **columns))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [r["words"] for r in totals]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(words))], max_repeats)
    passes = [min(max_repeats, int(g // w)) if w else 0 for g, w in zip(goal, words)]
    left = [max(0.0, g - p * w) for g, p, w in zip(goal, passes, words)]
    quotas = apportion(left, round(sum(left) / block_words), [-(-w // block_words) for w in words])
    shards = [max(1, -(-r["words"] // shard_words), -(-r["docs"] // shard_docs)) for r in totals]
    sources = session.createDataFrame(
        [
            (i, r["source"], w, g, p, n)
            for i, (r, w, g, p, n) in enumerate(zip(totals, words, goal, passes, shards))
        ],
        "source_no int, name string, source_size long, target double, passes long, shards long",
    )
    dealt = (
        narrow.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("rank", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "h"), "shards"))
    )
    totals_of_shards = pinned(dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("words")))
    shard_quota = shard_quotas(totals_of_shards, {i: int(q) for i, q in enumerate(quotas)}, block_words).toDF("no", "part", "quota")
    picked = (
        dealt.join(shard_quota, (F.col("source_no") == F.col("no")) & (F.col("shard") == F.col("part")))
        .groupBy("source_no", "shard")
        .applyInPandas(_select_blocks(block_words, seed), _PICKED)
    )
    taken = F.col("size") * F.col("passes") + F.col("b1") - F.col("a1") + F.col("b2") - F.col("a2")
    return picked.withColumn("taken", taken)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with only the words of the ranges; white space between words of a range stays."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    for batch in batches:
        out = []
        ranges = [batch.column(n).to_pylist() for n in ("__a1", "__b1", "__a2", "__b2")]
        for text, *bounds in zip(common.texts(batch, "__text"), *ranges):
            if bounds[0] is None:
                out.append(text.decode())
                continue
            at = [m.span() for m in word.finditer(text)]
            pieces = [(a, b) for a, b in (bounds[2:], bounds[:2]) if b > a]
            out.append(b"\n".join(text[at[a][0] : at[b - 1][1]] for a, b in pieces).decode())
        yield batch.set_column(batch.schema.get_field_index("__text"), "__text", pa.array(out, pa.string()))
        del out
    pa.default_memory_pool().release_unused()


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed documents, with the columns of ``docs``.

    A document comes once for each whole pass, and once more, cut to the words of its ranges, where blocks cover
    it. Documents that nothing is taken of are gone. Rows get a number when they are written to the shared folder and follow
    the plan of that number, so rows that repeat an id, whatever their texts, are documents of their own.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    columns = {key: f"c{names.index(c)}" for key, c in (("id_col", id_col), ("text_col", text_col), ("source_col", source_col))}
    numbered = pinned(plain.withColumn("__row", F.monotonically_increasing_id()))
    chosen = plan(numbered, row_col="__row", **columns, **settings).filter("taken > 0")
    copies = F.transform(
        F.sequence(F.lit(1), F.col("passes") + 1),
        lambda i: F.when(
            i > F.col("passes"), F.struct(*[F.col(c).alias(f"__{c}") for c in ("a1", "b1", "a2", "b2")])
        ).otherwise(F.struct(*[F.lit(None).cast("long").alias(f"__{c}") for c in ("a1", "b1", "a2", "b2")])),
    )
    kept = (
        chosen.select("row", F.explode(copies).alias("__copy")).select(F.col("row").alias("__row"), "__copy.*")
        .filter("__a1 IS NULL OR __b1 > __a1 OR __b2 > __a2")
    )
    text = columns["text_col"]
    joined = numbered.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).join(kept, "__row")
    cut = joined.mapInArrow(_cut, joined.schema).withColumn(text, F.col("__text"))
    return cut.select(*plain.columns).toDF(*names)
