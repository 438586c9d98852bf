"""Remove passages that occurred before, by suffix trees over parts of all suffixes that their prefixes split.

A suffix is what follows the start of a window of ``width`` words. Suffixes are split by prefixes of variable length: a
prefix runs from the start of the window to the end of its anchor, the gram of ``GRAM`` words with the least hash in
the window, so equal windows have equal prefixes, and only prefixes that end in a repeated gram can lead to a repeat.

* Grams at anchors are counted over all documents. A Bloom filter of the repeated ones, bounded in size, tells which
  anchors send the words of their windows on; grams that occur once stay where they are.
* Prefixes that end in the same gram are one group: their suffixes overlap, so the words of all of them travel once. In
  memory each group gets its tree: leaves in the order of their words, from ranks of ever longer prefixes, and the number
  of words that neighbours share. Internal nodes of at least ``width`` words are the repeats; each of their leaves but
  the earliest is marked, with the place of the earliest.
* A gram held by more than ``group_limit`` anchors is too large a group. Prefixes of its suffixes are made longer, up to
  the whole window, below which nothing is left to tell apart: an aggregate finds the earliest start of each node.
* Marked windows that follow each other, and whose earliest places do so too, are one maximal repeat, of any length.

Marked words are then taken out of the documents, which are shuffled once for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import bloom, common
from kartotek.sizing import pinned

WIDTH = 20
GRAM = 6
GROUP_LIMIT = 32_768
GROUP_ROWS = 30_000

_NO_ID = -(1 << 63)
_GRAMS = pa.schema([("gram", pa.int64())])
_SUFFIXES = pa.schema(
    [("gram", pa.int64()), ("doc", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("words", pa.binary())]
)
_WINDOWS = pa.schema(
    [("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("crc", pa.int64()), ("start", pa.int32())]
)
_MARKS = pa.schema(
    [
        ("doc", pa.int64()), ("crc", pa.int64()), ("low", pa.int32()), ("n", pa.int32()),
        ("first_doc", pa.int64()), ("first_crc", pa.int64()), ("first_low", pa.int32()),
    ]
)
_SUFFIXES_SQL = "gram long, doc long, crc long, start int, words binary"
_WINDOWS_SQL = "w1 long, w2 long, doc long, crc long, start int"
_MARKS_SQL = "doc long, crc long, low int, n int, first_doc long, first_crc long, first_low int"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def rolled(hashes: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    runs, step = len(hashes) - length + 1, np.uint64(factor)
    out = hashes[:runs].copy()
    for i in range(1, length):
        out *= step
        out += hashes[i : i + runs]
    return out


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and their windows: positions of grams, and first and last window start of each.

    The anchor of a window is the leftmost of its least grams.
    """
    span = width - GRAM + 1
    at, size = np.arange(len(grams)), 1
    while size < span:
        step = min(size, span - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        size += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def _anchored(text: bytes, width: int):
    """Words, word hashes, anchors with their windows, and the grams there; None for texts without a window."""
    words = text.split()
    if len(words) < width:
        return None
    hashes = word_hashes(words)
    grams = _scramble(rolled(hashes, GRAM, 0x9E3779B97F4A7C15))
    at, first, last = anchors(grams, width)
    return words, hashes, first, last, grams[at]


def _gram_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[4] for x in (_anchored(t, width) for t in common.texts(batch)) if x]
            if found:
                yield common.batch_of(_GRAMS, (pa.array(np.concatenate(found).view(np.int64)),))

    return run


def _ids(batch: pa.RecordBatch) -> list[int]:
    return batch.column("doc_id").fill_null(_NO_ID).to_pylist()


def _suffix_rows(width: int, repeated, hot):
    """The words of all windows of each anchor whose gram repeats, where the gram is no hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc, text in zip(_ids(batch), common.texts(batch)):
                if (found := _anchored(text, width)) is None:
                    continue
                words, _, first, last, grams = found
                send = bloom.contains(repeated.value, grams) & ~bloom.contains(hot.value, grams)
                if not send.any():
                    continue
                crc = zlib.crc32(text)
                for gram, a, b in zip(
                    grams[send].view(np.int64).tolist(), first[send].tolist(), last[send].tolist()
                ):
                    for column, value in zip(columns, (gram, doc, crc, a, b" ".join(words[a : b + width]))):
                        column.append(value)
            yield common.batch_of(_SUFFIXES, columns)

    return run


def _counted_up(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start a run of numbers from it, ``counts`` long, one run after the other; and the number of the run."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return starts[owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner], owner


def _window_rows(width: int, hot):
    """A 128-bit hash of each window whose anchor has a hot gram: its prefix at full length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, text in zip(_ids(batch), common.texts(batch)):
                if (found := _anchored(text, width)) is None:
                    continue
                _, hashes, first, last, grams = found
                send = bloom.contains(hot.value, grams)
                if not send.any():
                    continue
                start, _ = _counted_up(first[send], (last - first + 1)[send])
                w1 = _scramble(rolled(hashes, width, 0xC2B2AE3D27D4EB4F))[start]
                w2 = _scramble(rolled(_scramble(hashes), width, 0x165667B19E3779F9))[start]
                place = np.full(len(start), doc), np.full(len(start), zlib.crc32(text)), start.astype(np.int32)
                parts.append((w1.view(np.int64), w2.view(np.int64), *place))
            if parts:
                yield common.batch_of(_WINDOWS, [pa.array(np.concatenate(column)) for column in zip(*parts)])

    return run


def leaves(words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, within: np.ndarray, depth: int):
    """The suffix tree of pieces of text, as its leaves in order and the words that each shares with the one before.

    ``words`` holds the word hashes of all pieces, ``lengths`` their number in each; a suffix begins ``within`` words
    into its piece ``owner``, has ``depth`` words at least and ends with the piece. Neighbours that share so many words
    or more hang below a common internal node of that depth.
    """
    known, ids = np.unique(words, return_inverse=True)
    span = int(lengths.max()) + 1
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(len(words) + len(lengths) + 2 * span, dtype=np.int64)
    text[_counted_up(begin, lengths)[0]] = ids
    text[begin + lengths] = len(known) + np.arange(len(lengths))  # an end of its own for each piece

    def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1].astype(np.int64)

    ranks, length = [text], 1
    while 2 * length <= depth:
        ranks.append(paired(ranks[-1][:-length], ranks[-1][length:]))
        length *= 2
    at = begin[owner] + within
    rank, ranked = ranks[-1][at], length
    while ranked < span:
        rank = paired(rank, ranks[-1][at + ranked])
        ranked += length
    order = np.argsort(rank)
    left, right = at[order[:-1]], at[order[1:]]
    shared = np.zeros(len(left), dtype=np.int64)
    for level in [ranks[-1]] * (span // length) + ranks[-2::-1]:
        shared += np.where(level[left + shared] == level[right + shared], len(text) - len(level) + 1, 0)
    return order, shared


def _tree_marks(width: int, rows: int):
    """Marks of all leaves but the earliest of each internal node of ``width`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.whole_groups(batches, "gram", rows):
            pieces = [text.split() for text in group.column("words").to_pylist()]
            lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
            words = word_hashes([w for piece in pieces for w in piece])
            within, owner = _counted_up(np.zeros(len(pieces), dtype=np.int64), lengths - width + 1)
            order, shared = leaves(words, lengths, owner, within, width)
            deep = shared >= width
            node = np.cumsum(np.r_[True, ~deep])
            below = np.r_[False, deep] | np.r_[deep, False]
            leaf, node = order[below], node[below]
            if not len(leaf):
                continue
            doc, crc, start = (group.column(c).to_numpy() for c in ("doc", "crc", "start"))
            place = doc[owner], crc[owner], start[owner] + within
            by_place = np.lexsort((place[2][leaf], place[1][leaf], place[0][leaf], node))
            leaf, node = leaf[by_place], node[by_place]
            top = np.r_[True, node[1:] != node[:-1]]
            first = leaf[np.maximum.accumulate(np.where(top, np.arange(len(leaf)), 0))]
            later = np.zeros(len(leaf), dtype=bool)
            for column in place:
                later |= column[leaf] != column[first]
            leaf, first = leaf[later], first[later]
            in_text = np.argsort(leaf)
            leaf, first = leaf[in_text], first[in_text]
            if len(leaf):
                yield _mark_batch([c[leaf] for c in place], [c[first] for c in place])

    return run


def _breaks(place: list[np.ndarray], first: list[np.ndarray]) -> np.ndarray:
    """Where a window does not follow the one before, or its earliest place does not."""
    new = np.ones(len(place[0]), dtype=bool)
    new[1:] = False
    for column in (*place[:-1], *first[:-1]):
        new[1:] |= column[1:] != column[:-1]
    for column in (place[-1], first[-1]):
        new[1:] |= column[1:] != column[:-1] + 1
    return new


def _mark_batch(place: list[np.ndarray], first: list[np.ndarray]) -> pa.RecordBatch:
    """Marked windows as runs that follow each other here and where they occurred first."""
    begin = np.flatnonzero(_breaks(place, first))
    count = np.diff(np.r_[begin, len(place[0])])
    columns = [*(c[begin] for c in place), count, *(c[begin] for c in first)]
    return common.batch_of(_MARKS, [pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _MARKS)])


def marks(rows: DataFrame, width: int, group_limit: int, max_bits: int) -> DataFrame:
    """Runs of windows that occurred before, and where they occurred first."""
    context = rows.sparkSession.sparkContext
    counted = pinned(
        rows.select("text").mapInArrow(_gram_rows(width), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    large = counted.filter(F.col("n") > group_limit)
    repeated, hot = (
        context.broadcast(bloom.build(keys.select("gram"), bloom.filter_bits(keys.count(), max_bits)))
        for keys in (counted, large)
    )
    suffixes = rows.mapInArrow(_suffix_rows(width, repeated, hot), _SUFFIXES_SQL)
    found = suffixes.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _tree_marks(width, GROUP_ROWS), _MARKS_SQL
    )
    if large.isEmpty():
        return found
    windows = pinned(rows.mapInArrow(_window_rows(width, hot), _WINDOWS_SQL))
    place = F.struct("doc", "crc", "start")
    nodes = pinned(
        windows.groupBy(F.col("w1").alias("n1"), F.col("w2").alias("n2"))
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    later = windows.join(nodes, (F.col("w1") == F.col("n1")) & (F.col("w2") == F.col("n2"))).filter(
        place != F.col("first")
    )
    return found.unionByName(
        later.select(
            "doc", "crc", F.col("start").alias("low"), F.lit(1).alias("n"), F.col("first.doc").alias("first_doc"),
            F.col("first.crc").alias("first_crc"), F.col("first.start").alias("first_low"),
        )
    )


def _marked(rows: DataFrame, width: int, group_limit: int, max_bits: int) -> DataFrame:
    """The marks of each document in one row."""
    if width < GRAM:
        raise ValueError(f"windows need {GRAM} words or more")
    return marks(rows, width, group_limit, max_bits).groupBy("doc", "crc").agg(
        F.collect_set(F.struct("low", "n", "first_doc", "first_crc", "first_low")).alias("marks")
    )


def _windows_of(lists: pa.ListArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All marked windows once, in order: (row of the batch, start), and (doc, crc, start) where they occurred first."""
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    low, n, doc, crc, first_low = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5))
    start, run = _counted_up(low.astype(np.int64), n.astype(np.int64))
    order = np.lexsort((start, rows[run]))
    row, start, run, first = rows[run][order], start[order], run[order], (first_low[run] + (start - low[run]))[order]
    once = np.ones(len(row), dtype=bool)
    once[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1])
    run = run[once]
    return [row[once], start[once]], [doc[run], crc[run], first[once]]


def _repeats(width: int):
    """The maximal repeats of each document's marks."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64()), ("first_start", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (row, start), first = _windows_of(batch.column("marks"))
            begin = np.flatnonzero(_breaks([row, start], first))
            n_words = np.diff(np.r_[begin, len(row)]) + width - 1
            doc = batch.column("doc").to_numpy()[row[begin]]
            columns = (
                pa.array(doc, mask=doc == _NO_ID), start[begin], n_words,
                pa.array(first[0][begin], mask=first[0][begin] == _NO_ID), first[2][begin],
            )
            yield common.batch_of(schema, columns)

    return run


def _without(width: int, as_text: bool, with_lengths: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    schema = pa.schema(fields + [("n_repeats", pa.int64()), ("longest_repeat", pa.int64())] * with_lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            (row, start), first = _windows_of(batch.column("marks"))
            apart = np.ones(len(row), dtype=bool)
            apart[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + width)
            begin = np.flatnonzero(apart)
            low, high = start[begin].tolist(), (start[np.r_[begin[1:], len(row)] - 1] + width).tolist()
            bounds = np.searchsorted(row[begin], np.arange(batch.num_rows + 1)).tolist()
            for i, text in enumerate(common.texts(batch)):
                words, stay, at = text.split(), [], 0
                for j in range(bounds[i], bounds[i + 1]):
                    stay += words[at : low[j]]
                    at = high[j]
                stay += words[at:]
                joined = b" ".join(stay)
                counts.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(joined.decode() if as_text else sha256(joined).hexdigest())
            columns = [batch.column("doc_id"), counts, removed, kept]
            if with_lengths:
                begin = np.flatnonzero(_breaks([row, start], first))
                longest = np.zeros(batch.num_rows, dtype=np.int64)
                np.maximum.at(longest, row[begin], np.diff(np.r_[begin, len(row)]) + width - 1)
                columns += [np.bincount(row[begin], minlength=batch.num_rows), longest]
            yield common.batch_of(schema, columns)

    return run


def _kept(docs, id_col, text_col, width, group_limit, max_bits, as_text, with_lengths) -> DataFrame:
    rows = common.id_and_text(docs, id_col, text_col)
    marked = _marked(rows, width, group_limit, max_bits)
    own = rows.withColumn("__doc", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("__crc", F.crc32("text"))
    met = own.join(
        marked.hint("shuffle_hash"), (F.col("__doc") == F.col("doc")) & (F.col("__crc") == F.col("crc")), "left"
    ).select("doc_id", "text", "marks")
    lengths = ", n_repeats long, longest_repeat long" if with_lengths else ""
    return met.mapInArrow(
        _without(width, as_text, with_lengths), f"doc_id long, n_words long, n_removed long, kept string{lengths}"
    )


def substring_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    group_limit: int = GROUP_LIMIT, max_bits: int = bloom.MAX_BITS, with_lengths: bool = False,
) -> DataFrame:
    """As :func:`substring_dedup`, with the SHA-256 of the words that stay in place of the text.

    ``with_lengths`` adds n_repeats and longest_repeat: how many maximal repeats :func:`maximal_repeats` finds in the
    document, and the words of the longest, 0 if there are none.
    """
    found = _kept(docs, id_col, text_col, width, group_limit, max_bits, False, with_lengths)
    return found.withColumnRenamed("kept", "kept_sha256")


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    group_limit: int = GROUP_LIMIT, max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """Per document doc_id, n_words, n_removed and the words that stay, joined by single spaces.

    A word goes when a window of ``width`` words covers it whose words also start earlier: in a smaller id, or earlier
    in the document. Windows are judged on the input. Null texts have no words; a null id comes before all others, and
    the least long is taken for one; rows that share an id are ordered by a checksum of their text, and rows that
    repeat id and text are as one. No rows give no rows.
    """
    return _kept(docs, id_col, text_col, width, group_limit, max_bits, True, False).withColumnRenamed("kept", "text")


def maximal_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    group_limit: int = GROUP_LIMIT, max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """The passages that occurred before: doc_id, start, n_words, and first_doc_id and first_start where they did first.

    Each is as long as it can be: all its windows occurred first in one place, one after the other, and neither the
    window before nor the one after goes on so. Places count words from 0. Rows, nulls and order are as in
    :func:`substring_dedup`; a row that repeats another in id and text has no repeats of its own.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    return _marked(rows, width, group_limit, max_bits).mapInArrow(
        _repeats(width), "doc_id long, start long, n_words long, first_doc_id long, first_start long"
    )
