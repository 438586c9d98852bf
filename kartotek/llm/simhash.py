"""Near duplicates by SimHash fingerprints and a self-join of their binary trie.

Fingerprints that differ in two bits or fewer agree in at least one of three blocks of bits. The trie is therefore
built three times, with each block in turn as its first levels; only pairs of equal nodes at that depth are within
the budget there. Below it, pairs of nodes are walked down together, the bits in which they differ add up, and a
pair is left as soon as they exceed the budget.

A node at the depth of the block with more than ``node_limit`` fingerprints is split into pairs of nodes further
down, each pair within the budget being a unit of work of its own, so that no unit depends on the size of a hot
node. A unit returns a spanning forest of the links it found, never all pairs; components come from joins over
those (:mod:`kartotek.llm.graph`). Equal fingerprints are one leaf, whatever the number of their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import common
from kartotek.llm.graph import components
from kartotek.sizing import pinned

# Shingle length in words, seed of the hash, largest number of differing bits
SHINGLE_WORDS = 3
HASH_SEED = 42
BUDGET = 2

BLOCKS = (22, 21, 21)
NODE_LIMIT = 4_096
UNIT_ROWS = 200_000
FRONTIER = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LEAVES = pa.schema([("unit", pa.int64()), ("side", pa.int64()), ("bits", pa.int64()), ("turn", pa.int32())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes) -> int:
    """The 64 bits that are set in over half of the hashes of the shingles; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE_WORDS:
        hashes = digest(joined, HASH_SEED)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        hashes = b"".join(
            [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())]
        )
    counts = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    for start in range(0, len(rows), 1 << 15):
        counts += np.unpackbits(rows[start : start + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in common.texts(batch)], dtype=np.uint64).view(np.int64)
        yield common.batch_of(_PRINTS, (batch.column("doc_id"), pa.array(found)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    return common.id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _turned(values: np.ndarray, turn: int) -> np.ndarray:
    """Fingerprints rotated so that block ``turn`` comes first."""
    shift = sum(BLOCKS[:turn])
    if shift == 0:
        return values
    return (values << np.uint64(shift)) | (values >> np.uint64(64 - shift))


def _turned_back(values: np.ndarray, turn: int) -> np.ndarray:
    shift = sum(BLOCKS[:turn])
    if shift == 0:
        return values
    return (values >> np.uint64(shift)) | (values << np.uint64(64 - shift))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for each turn, with the node at the depth of the turn's block."""
    schema = pa.schema([("turn", pa.int32()), ("node", pa.int64()), ("bits", pa.int64())])
    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for turn, width in enumerate(BLOCKS):
            turned = _turned(values, turn)
            yield common.batch_of(
                schema,
                (
                    pa.array(np.full(len(values), turn, dtype=np.int32)),
                    pa.array((turned >> np.uint64(64 - width)).astype(np.int64)),
                    pa.array(turned.view(np.int64)),
                ),
            )


def flips(levels: int, budget: int = BUDGET) -> list[int]:
    """All changes of at most ``budget`` among ``levels`` bits."""
    return [sum(1 << b for b in at) for n in range(budget + 1) for at in combinations(range(levels), n)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with the units of work they belong to.

    A node of usual size is one unit. A large one has a unit for each pair of its descendants ``deeper`` levels down
    whose paths differ within the budget; a fingerprint belongs to all pairs with its own path.
    """
    for batch in batches:
        turn = batch.column("turn").to_numpy(zero_copy_only=False)
        node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.uint64)
        bits = batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
        deeper = batch.column("deeper").to_numpy(zero_copy_only=False)
        for t, d in {(int(a), int(b)) for a, b in zip(turn, deeper)}:
            pick = (turn == t) & (deeper == d)
            own, top = bits[pick], (node[pick] << np.uint64(2)) | np.uint64(t)
            width = BLOCKS[t]
            path = (own >> np.uint64(64 - width - d)) & np.uint64((1 << d) - 1)
            for flip in flips(d):
                other = path ^ np.uint64(flip)
                low, high = np.minimum(path, other), np.maximum(path, other)
                unit = np.uint64(d << 52) | (((top << np.uint64(d)) | low) << np.uint64(d)) | high
                side = (path < other) + 2 * (path > other)
                yield common.batch_of(
                    _LEAVES,
                    (
                        pa.array(unit.view(np.int64)), pa.array(side.astype(np.int64)), pa.array(own.view(np.int64)),
                        pa.array(np.full(len(own), t, dtype=np.int32)),
                    ),
                )


class _Forest:
    """Which leaves are linked; only the links that join two parts are kept."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def _settle(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.parent[left], self.parent[right]
            open_ = a != b
            if not open_.any():
                return
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self._settle()


def join_units(unit: np.ndarray, side: np.ndarray, bits: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """The part of each leaf after all leaves of a unit within ``budget`` bits were linked.

    Rows are ordered by unit, side and bits. A unit of side 0 is joined with itself, one of sides 1 and 2 is joined
    across them; where one of these is missing there is nothing to join.
    """
    size = len(bits)
    forest = _Forest(size)
    edge = np.flatnonzero(np.diff(unit) != 0) + 1
    start, stop = np.r_[0, edge], np.r_[edge, size]
    first = np.r_[0, np.cumsum(side == 1)]
    middle = start + first[stop] - first[start]
    across = side[start] > 0
    useful = ~across | ((middle > start) & (middle < stop))
    start, stop, middle, across = start[useful], stop[useful], middle[useful], across[useful]
    alo, ahi = start, np.where(across, middle, stop)
    blo, bhi = np.where(across, middle, start), stop
    stack = [(0, alo, ahi, blo, bhi, np.zeros(len(start), dtype=np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, error = stack.pop()
        same = alo == blo
        single = (ahi - alo == 1) & (bhi - blo == 1)
        leaf = single & ~same
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= budget
            forest.link(i[near], j[near])
        go = ~single
        alo, ahi, blo, bhi, error, same = (x[go] for x in (alo, ahi, blo, bhi, error, same))
        if not len(alo) or depth == 64:
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], error[half:]))
            stack.append((depth, alo[:half], ahi[:half], blo[:half], bhi[:half], error[:half]))
            continue
        set_ = np.r_[0, np.cumsum((bits >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        amid, bmid = ahi - (set_[ahi] - set_[alo]), bhi - (set_[bhi] - set_[blo])
        pairs = (
            (alo, amid, blo, bmid, error, True),
            (amid, ahi, bmid, bhi, error, True),
            (alo, amid, bmid, bhi, error + 1, True),
            (amid, ahi, blo, bmid, error + 1, ~same),
        )
        parts = []
        for a, b, c, d, e, wanted in pairs:
            stay = (b > a) & (d > c) & (e <= budget) & wanted
            parts.append([x[stay] for x in (a, b, c, d, e)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))
    return forest.parent


def _links(unit_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaves in common.whole_groups(batches, "unit", unit_rows):
            unit, side, bits, turn = (leaves.column(c).to_numpy() for c in ("unit", "side", "bits", "turn"))
            bits = bits.view(np.uint64)
            order = np.lexsort((bits, side, unit))
            unit, side, bits, turn = unit[order], side[order], bits[order], turn[order]
            root = join_units(unit, side, bits)
            linked = np.flatnonzero(root != np.arange(len(root)))
            for t in range(len(BLOCKS)):
                mine = linked[turn[linked] == t]
                u, v = (_turned_back(bits[x], t).view(np.int64) for x in (mine, root[mine]))
                yield common.batch_of(_EDGES, (pa.array(u), pa.array(v)))

    return run


def links(prints: DataFrame, node_limit: int = NODE_LIMIT, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """A spanning forest (u, v) of the links between the distinct fingerprints ``fp``."""
    nodes = prints.select("fp").mapInArrow(_nodes, "turn int, node long, bits long")
    large = pinned(
        nodes.groupBy(F.col("turn").alias("t"), F.col("node").alias("n"))
        .agg(F.count(F.lit(1)).alias("leaves"))
        .filter(F.col("leaves") > node_limit)
        .select("t", "n", F.least(F.ceil(F.log2(F.col("leaves") / node_limit)) + 1, F.lit(12)).cast("int").alias("levels"))
    )
    marked = nodes.join(large, (F.col("turn") == F.col("t")) & (F.col("node") == F.col("n")), "left").select(
        "turn", "node", "bits", F.coalesce("levels", F.lit(0)).alias("deeper")
    )
    units = marked.mapInArrow(_units, "unit long, side long, bits long, turn int")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_links(unit_rows), "u long, v long")


def clusters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_limit: int = NODE_LIMIT
) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest id that links lead to.

    Words are what white space leaves; texts with fewer than three words are one shingle, texts without words (null
    ones too) have fingerprint 0 and are linked like all others. A null id is a component's id only where it has no
    other. Rows that repeat an id are documents of their own. No rows give no rows.
    """
    prints = pinned(fingerprints(docs, id_col, text_col))
    leaves = pinned(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = pinned(components(links(leaves, node_limit)))
    rooted = leaves.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    parts = pinned(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = pinned(rooted.select("fp", "root").join(parts, "root").select(F.col("fp").alias("leaf"), "component_id"))
    return prints.join(named, F.col("fp") == F.col("leaf")).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with only the document of the smallest id of each component; rows that share an id go together."""
    gone = clusters(docs, id_col, text_col, **settings).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return common.without_ids(docs, pinned(gone.select("doc_id").distinct()), id_col)
