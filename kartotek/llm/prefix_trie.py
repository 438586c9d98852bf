"""The prefix trie of rebuilt conversations, from fingerprints that are put together and never from texts.

* A sequence of turns has a fingerprint in a monoid: its length and a polynomial of its turns' hashes, twice modulo
  2^61 - 1. The fingerprint of a sequence is the product of those of its pieces, so prefixes that lie in several
  sorted partitions get theirs from one carry a partition, and a conversation rebuilt from the head of another one and
  its own remaining turns gets all of its prefixes from products of fingerprints.
* Conversations that share a fingerprint at a depth are a node. Every row refers to the stored turn that ends its prefix
  and carries 128 bits of that turn's SHA-256; a node whose members differ in them or in the node above raises an error.
* A node is named by its smallest member. The nodes named by one conversation are a suffix of its path, a chain, so
  sums over subtrees need no rounds: a node's sum is what its own chain holds from it downwards plus the whole chains
  of the other members whose chains lie below it.

Texts are read once and never shuffled. A conversation with many turns is spread over many sorted partitions and over
blocks of bounded depth; the ids that end in a node are joined in bounded pieces and hashed as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kartotek.llm import common
from kartotek.sizing import pinned

# The modulus and the two bases of the fingerprints
PRIME = (1 << 61) - 1
BASES = (1_461_501_637_330_902_917, 1_208_925_819_614_629_173)

ID_BLOCK = 100
HEADS = 6
DEPTH_BLOCK = 4_096
PIECE_IDS = 4_096

_NODE = ["depth", "f1", "f2"]
_TURN = "conv_id long, turn long, e1 long, e2 long, d1 long, d2 long, chars long"
_PLACED = (
    "part int, carry boolean, conv_id long, place long, f1 long, f2 long, g1 long, g2 long, d1 long, d2 long, chars long"
)
_PREFIX = (
    "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, d1 long, d2 long, chars long, turn_conv long, "
    "turn_place long, last boolean"
)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in text.split(", "))])


# The monoid


def times(a: np.ndarray, b) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    low31 = np.uint64((1 << 31) - 1)
    a, b = np.asarray(a, dtype=np.uint64), np.asarray(b, dtype=np.uint64)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low31, b >> np.uint64(31), b & low31
    middle = a1 * b0 + a0 * b1
    whole = (
        np.uint64(2) * (a1 * b1) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    )
    return _reduced((whole & np.uint64(PRIME)) + (whole >> np.uint64(61)))


def _reduced(x: np.ndarray) -> np.ndarray:
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each of the exponents, modulo the prime."""
    out, left = np.ones(len(exponents), dtype=np.uint64), np.asarray(exponents, dtype=np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), times(out, np.uint64(base)), out)
        base, left = base * base % PRIME, left >> np.uint64(1)
    return out


def joined(first: int, second: int, length: int, base: int) -> int:
    """The fingerprint of a sequence followed by one of the given length."""
    return (first * pow(base, length, PRIME) + second) % PRIME


def moved(values: np.ndarray, before: np.ndarray, instead: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Fingerprints of sequences that begin with ``before``, with ``instead`` in its place; ``powers`` are those of what follows."""
    swap = _reduced(instead.astype(np.uint64) + np.uint64(PRIME) - before.astype(np.uint64))
    return _reduced(values.astype(np.uint64) + times(swap, powers)).astype(np.int64)


# Turns in their order


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and code points of each turn."""
    schema = _schema(_TURN)
    for batch in batches:
        digests, chars = [], []
        for role, text in zip(common.texts(batch, "role"), common.texts(batch)):
            digests.append(sha256(b"%d:%b%b" % (len(role), role, text)).digest())
            chars.append(common.code_points(text))
        parts = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 4)
        elements = (parts[:, :2] % np.uint64(PRIME)).astype(np.int64)
        checks = parts[:, 2:].view(np.int64)
        columns = [pa.array(np.ascontiguousarray(m[:, i])) for m in (elements, checks) for i in (0, 1)]
        yield common.batch_of(schema, (batch.column("conv_id"), batch.column("turn"), *columns, chars))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefixes within this partition, then a row of what the last conversation carries over."""
    schema, part = _schema(_PLACED), TaskContext.get().partitionId()
    b1, b2 = BASES
    conv, place, f1, f2 = None, 0, 0, 0
    for batch in batches:
        out = []
        for c, e1, e2 in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "e1", "e2"))):
            if c != conv:
                conv, place, f1, f2 = c, 0, 0, 0
            before1, before2 = f1, f2
            place, f1, f2 = place + 1, (f1 * b1 + e1) % PRIME, (f2 * b2 + e2) % PRIME
            out.append((place, f1, f2, before1, before2))
        columns = np.array(out, dtype=np.int64).reshape(-1, 5)
        n = batch.num_rows
        yield common.batch_of(
            schema,
            (
                pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.zeros(n, dtype=bool)), batch.column("conv_id"),
                *(pa.array(np.ascontiguousarray(columns[:, i])) for i in range(5)),
                *(batch.column(name) for name in ("d1", "d2", "chars")),
            ),
        )
    if conv is not None:
        yield common.batch_of(schema, [[v] for v in (part, True, conv, place, f1, f2, 0, 0, 0, 0, 0)])


def _carries(rows: list) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each conversation that ends a partition: that partition, and the turns and fingerprints up to its end."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        held = out.setdefault(r["conv_id"], [])
        _, n, f1, f2 = held[-1] if held else (0, 0, 0, 0)
        held.append(
            (r["part"], n + r["place"], joined(f1, r["f1"], r["place"], BASES[0]), joined(f2, r["f2"], r["place"], BASES[1]))
        )
    return out


def _carried(carries):
    """Places and prefixes within the whole conversation."""
    names = ["conv_id", "place", "f1", "f2", "g1", "g2", "d1", "d2", "chars"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, place = (batch.column(n).to_numpy() for n in ("part", "conv_id", "place"))
            before = np.zeros((3, len(conv)), dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])]) if len(conv) else []
            for a, b in zip(starts, [*starts[1:], len(conv)]):
                earlier = [held for held in carries.get(int(conv[a]), ()) if held[0] < part[a]]
                if earlier:
                    before[:, a:b] = np.array(earlier[-1][1:])[:, None]
            values = {}
            for i, base in enumerate(BASES, 1):
                p = power(base, place - 1)
                none = np.zeros(len(conv), dtype=np.int64)
                values[f"g{i}"] = moved(batch.column(f"g{i}").to_numpy(), none, before[i], p)
                values[f"f{i}"] = moved(batch.column(f"f{i}").to_numpy(), none, before[i], times(p, np.uint64(base)))
            values |= {"conv_id": conv, "place": place + before[0]}
            yield common.batch_of(schema, [values[n] if n in values else batch.column(n) for n in names])

    return run


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), fingerprints up to (f1, f2) and before (g1, g2) each turn, check bits and code points.

    Turns are ordered by number, null first; equal numbers by a digest of role and text, so that rows in any order give
    the same. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")],
    )
    # Equal rows may be many; a last key without meaning lets them lie in several partitions
    turns = rows.mapInArrow(_turns, _TURN).withColumn("__row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "d1", "d2", "__row"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pinned(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_placed, _PLACED))
    carries = _carries(placed.filter("carry").select("part", "conv_id", "place", "f1", "f2").collect())
    schema = "conv_id long, place long, f1 long, f2 long, g1 long, g2 long, d1 long, d2 long, chars long"
    return placed.filter("NOT carry").mapInArrow(_carried(carries), schema)


# Rebuilt conversations


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes that end in an own turn, after the head of the base took the place of the own head."""
    schema = _schema(_PREFIX)
    for batch in batches:
        col = {name: batch.column(name).to_numpy() for name in batch.schema.names}
        after = col["place"] - col["h"]
        depth = col["k"] + after
        out = {"conv_id": col["conv_id"], "depth": depth, "turn_conv": col["conv_id"], "turn_place": col["place"]}
        for i, base in enumerate(BASES, 1):
            p = power(base, after - 1)
            out[f"p{i}"] = moved(col[f"g{i}"], col[f"v{i}"], col[f"b{i}"], p)
            out[f"f{i}"] = moved(col[f"f{i}"], col[f"v{i}"], col[f"b{i}"], times(p, np.uint64(base)))
        out["last"] = depth == col["depths"]
        yield common.batch_of(schema, [pa.array(out[f.name] if f.name in out else col[f.name]) for f in schema])


def prefixes(conversations: DataFrame, block: int = ID_BLOCK, heads: int = HEADS) -> DataFrame:
    """A row for every prefix of every rebuilt conversation, from none to all of its turns, as references to turns.

    Conversation c is rebuilt as the first h turns of conversation c - c % block (the remainder has the sign of c), then
    its own turns after its first h, with h the CRC-32 of c in decimals modulo ``heads``.
    """
    turns = pinned(ordered_turns(conversations))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).alias("h")
    at_head = F.col("place") == F.col("h")
    convs = (
        turns.select("conv_id", "place", "f1", "f2", h)
        .groupBy("conv_id", "h")
        .agg(
            F.max("place").alias("n"),
            *[F.coalesce(F.max(F.when(at_head, F.col(f"f{i}"))), F.lit(0)).cast("long").alias(f"v{i}") for i in (1, 2)],
        )
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    )
    head = F.struct("place", "f1", "f2", F.col("g1").alias("p1"), F.col("g2").alias("p2"), "d1", "d2", "chars")
    bases = (
        turns.filter((F.col("place") < heads) & (F.col("conv_id") % block == 0))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(head)).alias("head"))
    )
    held = F.filter(F.coalesce(F.col("head"), F.array()), lambda turn: turn["place"] <= F.col("h"))
    built = convs.join(bases, "base", "left").withColumn("head", held).withColumn("k", F.size("head").cast("long"))
    last = F.try_element_at("head", F.greatest(F.col("k"), F.lit(1)).cast("int"))
    built = pinned(
        built.select(
            "conv_id", "base", "h", "k", "v1", "v2", "head",
            *[F.coalesce(last[f"f{i}"], F.lit(0)).cast("long").alias(f"b{i}") for i in (1, 2)],
            (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depths"),
        )
    )
    zero = F.lit(0).cast("long")
    root = built.select(
        "conv_id", *[zero.alias(n) for n in ("depth", "f1", "f2", "p1", "p2", "d1", "d2", "chars")],
        *[F.lit(None).cast("long").alias(n) for n in ("turn_conv", "turn_place")], (F.col("depths") == 0).alias("last"),
    )
    from_base = built.select("conv_id", "base", "depths", F.explode("head").alias("turn")).select(
        "conv_id", F.col("turn.place").alias("depth"),
        *[F.col(f"turn.{n}").alias(n) for n in ("f1", "f2", "p1", "p2", "d1", "d2", "chars")],
        F.col("base").alias("turn_conv"), F.col("turn.place").alias("turn_place"),
        (F.col("turn.place") == F.col("depths")).alias("last"),
    )
    own = turns.join(built.select("conv_id", "h", "k", "b1", "b2", "v1", "v2", "depths"), "conv_id").filter("place > h")
    return root.unionByName(from_base).unionByName(own.mapInArrow(_rebuilt, _PREFIX))


# The trie


@dataclass
class Trie:
    """``nodes``: a row a node, keyed by (depth, f1, f2), with its figures and a reference to the turn that ends it.
    ``ends``: conv_id of every rebuilt conversation and the node in which it ends."""

    nodes: DataFrame
    ends: DataFrame


def _same(name: str, what: str):
    """The one value of a column in a group, or an error."""
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(F.raise_error(F.lit(f"fingerprints meet by chance: {what}")))


def prefix_trie(conversations: DataFrame, block: int = ID_BLOCK, heads: int = HEADS) -> Trie:
    """The trie of rebuilt conversations. Nodes have the columns depth, f1, f2, conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, turn_conv and turn_place (null for the root).

    Equal conversations are members of the same nodes. No rows give no nodes; a single conversation of which nothing
    is left gives the root alone.
    """
    rows = pinned(prefixes(conversations, block, heads))
    found = rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        *[_same(n, "turns differ").alias(n) for n in ("d1", "d2")],
        *[_same(n, "nodes above differ").alias(n) for n in ("p1", "p2")],
        *[F.min_by(n, "conv_id").alias(n) for n in ("turn_conv", "turn_place")],
    )
    nodes = pinned(
        found.filter("d1 IS NOT NULL AND d2 IS NOT NULL").drop("d1", "d2").withColumn(
            "blk", F.expr(f"depth div {DEPTH_BLOCK}")
        )
    )
    saved = (F.col("n_convs") - 1) * F.col("chars")
    blocks = nodes.groupBy("conv_id", "blk").agg(
        F.sum(saved).alias("in_block"), F.min("depth").alias("low"), F.max("depth").alias("high")
    )
    chain = Window.partitionBy("conv_id")
    below = chain.orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "blk", F.coalesce(F.sum("in_block").over(below), F.lit(0)).alias("below"),
        F.min("low").over(chain).alias("top"), F.max("high").over(chain).alias("end"),
    )
    inside = Window.partitionBy("conv_id", "blk").orderBy(F.desc("depth"))
    chained = pinned(
        nodes.join(blocks, ["conv_id", "blk"])
        .withColumn("own", F.sum(saved).over(inside) + F.col("below"))
        .drop("blk", "below", "chars")
    )
    tops = chained.filter("depth = top AND depth > 0").select(
        *_NODE, (F.col("depth") - 1).alias("up_depth"), F.col("p1").alias("up_f1"), F.col("p2").alias("up_f2")
    )
    up = [F.col(f"up_{n}").alias(n) for n in _NODE]
    attached = tops.groupBy(*up).agg(F.count(F.lit(1)).alias("attached"))
    goes_on = (F.col("depth") < F.col("end")).cast("long")
    counted = pinned(
        chained.join(attached, _NODE, "left").withColumn("n_children", goes_on + F.coalesce("attached", F.lit(0))).drop("attached")
    )
    childless = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    chains = (
        counted.filter("depth = top OR depth = end").groupBy("conv_id")
        .agg(
            F.min("top").alias("top"), F.max(childless).alias("leaves"),
            F.max(F.when(F.col("depth") == F.col("top"), F.col("own"))).alias("whole"),
        )
        .filter("whole > 0 OR leaves > 0")
    )
    passing = (
        rows.select("conv_id", *_NODE).join(pinned(chains), "conv_id").groupBy(*_NODE)
        .agg(F.sum(F.when(F.col("depth") < F.col("top"), F.col("whole"))).alias("others"), F.sum("leaves").alias("n_leaves"))
    )
    parents = tops.join(
        counted.select(*[F.col(n).alias(f"up_{n}") for n in _NODE], F.col("conv_id").alias("up")), [f"up_{n}" for n in _NODE]
    ).select(*_NODE, "up")
    out = (
        counted.join(passing, _NODE, "left").join(parents, _NODE, "left").select(
            *_NODE, "conv_id",
            F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("top"), F.col("up"))
            .otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
            (F.col("own") + F.coalesce("others", F.lit(0))).alias("saved_tokens"), "turn_conv", "turn_place",
        )
    )
    return Trie(out, rows.filter("last").select("conv_id", *_NODE))


# Digests of the ids that end in a node


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in a row, joined by commas, some thousand at a time."""
    schema = _schema("depth long, f1 long, f2 long, first long, ids string")
    node, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for *key, conv in zip(*(batch.column(n).to_pylist() for n in (*_NODE, "conv_id"))):
            if key != node or len(ids) >= PIECE_IDS:
                close()
                node = key
            ids.append(conv)
        yield common.batch_of(schema, zip(*out) if out else [[]] * 5)
        out.clear()
    close()
    if out:
        yield common.batch_of(schema, zip(*out))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node in their order, fed as they come."""
    schema = _schema("depth long, f1 long, f2 long, ends_sha256 string")
    node, state, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*_NODE, "ids"))):
            if key != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield common.batch_of(schema, zip(*out) if out else [[]] * 4)
        out.clear()
    if node is not None:
        yield common.batch_of(schema, [[v] for v in (*node, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, f1, f2 and the SHA-256 of the ids that end in the node, ascending and joined by commas."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_NODE, "conv_id"]
    pieces = (
        ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_pieces, "depth long, f1 long, f2 long, first long, ids string")
    )
    return (
        pieces.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first")
        .mapInArrow(_hashed, "depth long, f1 long, f2 long, ends_sha256 string")
    )


def trie_digests(conversations: DataFrame, block: int = ID_BLOCK, heads: int = HEADS) -> DataFrame:
    """The nodes of :func:`prefix_trie` with a digest of the ids that end in each; that of nothing where none do."""
    trie = prefix_trie(conversations, block, heads)
    none = F.lit(sha256(b"").hexdigest())
    return trie.nodes.join(end_digests(trie.ends), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
