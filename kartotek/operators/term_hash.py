"""Looking terms up where the rows are, in a minimal perfect hash of the dictionary.

A dictionary becomes one or more shards, each built in a task. In a shard, keys that meet no other key at a level of a bit array
are settled there, and the others go on to the next level; a key's slot is the number of bits set before its own, so
n terms take n slots. A slot holds the term's number and the 64 bits of its hash as check bits, which turn terms away that
the dictionary does not have. Shards are bounded in terms and in number; a larger dictionary is left to a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_TERMS = 1 << 20
MOST_SHARDS = 8
LEVELS = 64
# Fixed value: the seed of the engine's 64-bit hash of texts
_SEED = 42


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shard:
    """A minimal perfect hash from 64-bit keys to numbers."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.words: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        left, base = keys, 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.ranks.append((base + np.cumsum(counts) - counts).astype(np.int32))
            base += int(counts.sum())
            left = left[~alone[at]]
        if len(left):
            raise ValueError("two terms of the dictionary have the same 64-bit hash, or a term is there twice")
        slots = self._slots(keys)
        self.checks, self.numbers = np.empty(len(keys), np.uint64), np.empty(len(keys), np.int64)
        self.checks[slots], self.numbers[slots] = keys, numbers

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level holds it."""
        out, active = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks)):
            if not len(active):
                break
            at = _mixed(keys[active], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[active[hit]] = (ranks[word] + before)[hit]
            active = active[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not there."""
        if not len(self.checks):
            return np.full(len(keys), -1, np.int64)
        slots = self._slots(keys)
        known = (slots >= 0) & (self.checks[slots] == keys)
        return np.where(known, self.numbers[slots], -1)


def hashes(terms: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t, _SEED) for t in terms], dtype=np.uint64)


class TermHash:
    """The shards of a dictionary, sent once to every executor."""

    def __init__(self, shards: list[Broadcast], size: int):
        self.shards, self.size = shards, size

    def find(self, terms: list[bytes]) -> np.ndarray:
        """The number of each term, -1 where the dictionary lacks it."""
        keys = hashes(terms)
        if len(self.shards) == 1:
            return self.shards[0].value.find(keys)
        out, shard = np.full(len(keys), -1, np.int64), (keys >> np.uint64(32)) % np.uint64(len(self.shards))
        for i, held in enumerate(self.shards):
            mine = shard == i
            if mine.any():
                out[mine] = held.value.find(keys[mine])
        return out


def term_hash(
    dictionary: DataFrame, shard_terms: int = SHARD_TERMS, most_shards: int = MOST_SHARDS, strict: bool = True
) -> TermHash | None:
    """The hash of a dictionary with ``term`` and ``term_index``, or None when it has too many terms.

    Terms are counted before anything is sent. Unless they are numbered 0, 1, 2, ... without gap or repeat there is an
    error, or None when not ``strict``; a null term is left out, as no token equals it.
    """
    n = dictionary.count()
    count = max(1, -(-n // shard_terms))
    if count > most_shards:
        return None
    hashed = dictionary.select("term", F.xxhash64("term").alias("h"), F.col("term_index").cast("long").alias("term_index"))
    shard = F.pmod(F.shiftrightunsigned("h", 32), F.lit(count))
    rows = (
        hashed.withColumn("shard", shard).repartition(count, "shard")
        .mapInArrow(_split_shards, "shard long, known long, keys binary, numbers binary").collect()
    )
    numbers = np.concatenate([np.frombuffer(r["numbers"], np.int64) for r in rows] or [np.empty(0, np.int64)])
    if n and (numbers.min() != 0 or numbers.max() != n - 1 or len(np.unique(numbers)) != n):
        if not strict:
            return None
        raise ValueError(
            f"{n} terms numbered {numbers.min()} to {numbers.max()} with {len(np.unique(numbers))} different numbers"
        )
    held = {r["shard"]: r for r in rows}
    none = np.empty(0, np.int64)
    context, shards = dictionary.sparkSession.sparkContext, []
    for i in range(count):
        keys, values = (
            (np.frombuffer(held[i][c], np.int64) for c in ("keys", "numbers")) if i in held else (none, none)
        )
        known = held[i]["known"] if i in held else 0
        shards.append(context.broadcast(Shard(keys[:known].view(np.uint64), values[:known])))
    return TermHash(shards, n)


def _split_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard of a partition as one row: its keys, and their numbers followed by those of null terms."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        shard, key, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "h", "term_index"))
        present = batch.column("term").is_valid().to_numpy(zero_copy_only=False)
        for i in np.unique(shard).tolist():
            mine = shard == i
            found.setdefault(i, []).append((key[mine], number[mine].astype(np.int64), present[mine]))
    for i, parts in found.items():
        key, number, present = (np.concatenate([p[j] for p in parts]) for j in range(3))
        order = np.argsort(~present, kind="stable")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i], pa.int64()), pa.array([int(present.sum())], pa.int64()),
                pa.array([key[order][: int(present.sum())].astype(np.int64).tobytes()], pa.binary()),
                pa.array([number[order].tobytes()], pa.binary()),
            ],
            names=["shard", "known", "keys", "numbers"],
        )


def counted_numbers(tokens: pa.Array, terms: TermHash, unknown: str = "drop") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and count of the dictionary's terms in each row of a batch of token lists, by row and number."""
    rows = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    flat = pc.list_flatten(tokens).dictionary_encode()
    numbers = terms.find(flat.dictionary.cast(pa.binary()).to_pylist())
    if unknown == "error" and (numbers < 0).any():
        raise ValueError(f"term not in the dictionary: {flat.dictionary[int(np.argmin(numbers))].as_py()}")
    present = flat.indices.is_valid().to_numpy(zero_copy_only=False)
    number = numbers[flat.indices.drop_null().to_numpy()]
    rows, number = rows[present][number >= 0], number[number >= 0]
    width = max(terms.size, 1)
    pairs, n = np.unique(rows * width + number, return_counts=True)
    return pairs // width, pairs % width, n
