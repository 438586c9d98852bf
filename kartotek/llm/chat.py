"""Chat formatting by prefix trees.

Conversations that begin with the same turns share them. Each turn is a node, named by a fingerprint of itself and all
turns before it; equal nodes are one. Nodes in depth-first order form one stream of tokens in which every shared turn
comes once.

The tree is kept in its compressed form. An edge begins at a child of a fork (or of the root) and runs down to the next
fork or leaf; its nodes follow each other in the stream, whatever their number. A node's key is the list of the edges
that lead to it, each as depth and name of its first node, and its own depth: sorting by key is the depth-first order.
A conversation of n turns that shares k times has keys of at most k + 1 entries, however large n is, and k forks on one
path need some k^2 / 2 turns in other conversations.

Each segment (node) carries its place in the stream, the position id of its first token (the number of tokens of its
ancestors), the range of tokens that count for the loss, and the intervals of its ancestors in the stream: a token
attends to these and to the tokens of its own segment up to itself. An edge is one interval, and intervals that touch
are joined. A pass over each partition of the ordered stream finds them; only the edges above the first node of a
partition are looked up across partitions. A table of paths tells which segments make up each conversation.

Turns are sorted over all partitions, so a long conversation lies in several: fingerprints are put together from one
carry a partition. Nothing holds a conversation in one row. Reading back hashes a conversation as a stream, in one task
as SHA-256 asks, after its segments were decoded where they lie.

A turn is written ``<turn:ROLE>``, a line feed, the text, ``</turn>`` and a line feed. Inside roles and texts a
backslash stands before what could be taken for these, and before backslashes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import common
from kartotek.llm.prefix_trie import BASES, PRIME, joined, moved, power, times
from kartotek.llm.token_files import _byte_letters
from kartotek.sizing import lookup_join, pinned

LOSS_ROLE = "assistant"
CACHE_PIECES = 200_000
RANGE_CHARS = 64

_CONTROL = re.compile(r"\\|<(?=/turn>|turn:)")
_ROLE_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn:((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.|<(?!/turn>|turn:))*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def pieces(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, in and after a turn's text."""
    return "<turn:" + _ROLE_CONTROL.sub(r"\\\g<0>", role) + ">\n", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of formatted turns."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


# The letters, marks and spaces whose classes are the same in every version of Unicode, and the pieces into
# which a byte-level pre-tokeniser splits a text of these
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACES = r"\t-\r "
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTERS}¡«»¿–—‘-‟…]*")
_PIECE = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Codec:
    """Ids of texts and texts of ids.

    Where the tokenizer file is byte-level BPE in its plain form, texts of common letters and marks are split here and
    each piece is encoded once, and ids stand for bytes. All else goes through the tokenizer.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tokenizer = tokenizer_of(path)
        held = json.loads(self.tokenizer.to_str())
        splits = {k: v for k, v in (held.get("pre_tokenizer") or {}).items() if k != "trim_offsets"}
        decoder, added = held.get("decoder") or {}, held.get("added_tokens", [])
        model = held.get("model", {})
        bytes_only = model.get("type") == "BPE" and decoder.get("type") == "ByteLevel"
        self.by_piece = (
            bytes_only and splits == _BYTE_LEVEL and held.get("normalizer") is None and not held.get("truncation")
            and not held.get("padding") and all(t["special"] for t in added)
            and not model.get("dropout") and not model.get("end_of_word_suffix")
            and not model.get("continuing_subword_prefix")
        )
        self.letters = _byte_letters()
        self.pieces = common.Memo(self._piece, cache_pieces)
        self.bytes_of = self._bytes_of(added) if bytes_only else None

    def _bytes_of(self, added: list[dict]) -> list[bytes]:
        values = {letter: byte for byte, letter in enumerate(self.letters)}
        out = [b""] * (max(self.tokenizer.get_vocab().values(), default=-1) + 1)
        for word, number in self.tokenizer.get_vocab().items():
            if all(letter in values for letter in word):
                out[number] = bytes(values[letter] for letter in word)
        for token in added:
            out[token["id"]] = token["content"].encode()
        return out

    def _piece(self, piece: str) -> bytes:
        letters = "".join(map(self.letters.__getitem__, piece.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], dtype="<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.by_piece and _PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes() if text else b""

    def decode(self, ids: np.ndarray) -> str:
        if self.bytes_of is not None:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a process, so that its cache outlives a task."""
    return Codec(path)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in text.split(", "))])


# Names of turns

_REF = "part int, carry boolean, row long, none boolean, conv long, place long, f1 long, f2 long, g1 long, g2 long, proof long"
_PLACED = f"{_REF}, role string, text string"
_NAMED = "part int, row long, none boolean, conv long, place long, n1 long, n2 long, p1 long, p2 long, proof long"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns with their places and fingerprints within the partition, then a row of what its last conversation carries on."""
    schema, part = _schema(_PLACED), TaskContext.get().partitionId()
    b1, b2 = BASES
    own, row, place, f1, f2 = None, 0, 0, 0, 0
    for batch in batches:
        out = []
        ids = zip(batch.column("none").to_pylist(), batch.column("conv").to_pylist())
        for conv, role, text in zip(ids, common.texts(batch, "role"), common.texts(batch)):
            if conv != own:
                own, place, f1, f2 = conv, 0, 0, 0
            digest = sha256(b"%d:%b%b" % (len(role), role, text)).digest()
            e1, e2 = (int.from_bytes(digest[i : i + 8], "little") % PRIME for i in (0, 8))
            before1, before2 = f1, f2
            place, f1, f2 = place + 1, (f1 * b1 + e1) % PRIME, (f2 * b2 + e2) % PRIME
            out.append((row, place, f1, f2, before1, before2, int.from_bytes(digest[16:24], "little", signed=True)))
            row += 1
        columns = np.array(out, dtype=np.int64).reshape(-1, 7)
        n = batch.num_rows
        column = [pa.array(np.ascontiguousarray(columns[:, i])) for i in range(7)]
        yield common.batch_of(
            schema,
            (
                pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.zeros(n, dtype=bool)), column[0],
                batch.column("none"), batch.column("conv"), *column[1:], batch.column("role"), batch.column("text"),
            ),
        )
    if own is not None:
        yield common.batch_of(schema, [[v] for v in (part, True, row, *own, place, f1, f2, 0, 0, 0, None, None)])


def _carries(rows: list) -> dict[tuple, list[tuple[int, int, int, int]]]:
    """For each conversation that ends a partition: that partition, and the turns and fingerprints up to its end."""
    out: dict[tuple, list[tuple[int, int, int, int]]] = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        held = out.setdefault((r["none"], r["conv"]), [])
        _, n, f1, f2 = held[-1] if held else (0, 0, 0, 0)
        ends = (joined(f, r[name], r["place"], base) for f, name, base in zip((f1, f2), ("f1", "f2"), BASES))
        held.append((r["part"], n + r["place"], *ends))
    return out


def _name(carries: dict[tuple, list[tuple[int, int, int, int]]]):
    """Places and fingerprints within the whole conversation: a turn's own name and that of the turn before."""
    schema = _schema(_NAMED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, place = (batch.column(n).to_numpy() for n in ("part", "conv", "place"))
            none = batch.column("none").to_numpy(zero_copy_only=False)
            new = np.ones(len(conv), dtype=bool)
            new[1:] = (conv[1:] != conv[:-1]) | (part[1:] != part[:-1]) | (none[1:] != none[:-1])
            starts = np.flatnonzero(new)
            before = np.zeros((3, len(conv)), dtype=np.int64)
            for a, b in zip(starts, [*starts[1:], len(conv)]):
                held = [h for h in carries.get((bool(none[a]), int(conv[a])), ()) if h[0] < part[a]]
                if held:
                    before[:, a:b] = np.array(held[-1][1:])[:, None]
            nothing, names = np.zeros(len(conv), dtype=np.int64), {}
            for i, base in enumerate(BASES, 1):
                p = power(base, place - 1)
                names[f"p{i}"] = moved(batch.column(f"g{i}").to_numpy(), nothing, before[i], p)
                names[f"n{i}"] = moved(batch.column(f"f{i}").to_numpy(), nothing, before[i], times(p, np.uint64(base)))
            names["place"] = place + before[0]
            yield common.batch_of(schema, [pa.array(names[f.name]) if f.name in names else batch.column(f.name) for f in schema])

    return run


# The stream

_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SEGMENTS = pa.schema(
    [
        ("n1", pa.int64()), ("n2", pa.int64()), ("depth", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()),
        ("part", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("outer", pa.int32()), ("held", _INTERVALS),
        ("role", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("tokens", pa.list_(pa.int32())),
    ]
)
_SEGMENTS_SQL = (
    "n1 long, n2 long, depth long, e1 long, e2 long, part int, local long, n_tokens long, outer int, "
    "held array<struct<start: long, end: long>>, role string, loss_from int, loss_to int, tokens array<int>"
)

Intervals = tuple[tuple[int, int], ...]


def _with_interval(held: Intervals, start: int, end: int) -> Intervals:
    """Intervals with one more behind them, joined to the last where they touch; an empty one changes nothing."""
    if start == end:
        return held
    if held and held[-1][1] == start:
        return (*held[:-1], (held[-1][0], end))
    return (*held, (start, end))


def _lists(pieces: list[bytes], width: int = 4) -> pa.ListArray:
    """Arrays of 32-bit integers from their bytes."""
    offsets = np.cumsum([0, *(len(p) // width for p in pieces)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(pieces), dtype="<i4")))


def _encode(path: str, loss_role: str):
    """Tokens of the nodes of one ordered partition, their places in it, and the intervals of ancestors that lie in it.

    ``outer`` is the number of edges above the partition's first node that lead to the node as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = codec(path), TaskContext.get().partitionId(), 0
        edges: list[tuple[int, int, Intervals]] = []  # level, start and what lies above, of the open edges
        ends: dict[int, int] = {}
        outer = None
        for batch in batches:
            rows, ids = [], []
            named = zip(*(batch.column(n).to_pylist() for n in ("n1", "n2", "depth", "e1", "e2", "level", "top", "role")))
            for (n1, n2, depth, e1, e2, level, top, role), text in zip(named, common.texts(batch)):
                begins = depth == top
                if outer is None:
                    outer = level - 1 if begins else level
                if begins:
                    outer = min(outer, level - 1)
                    while edges and edges[-1][0] >= level:
                        edges.pop()
                    held = _with_interval(edges[-1][2], edges[-1][1], ends[edges[-1][0]]) if edges else ()
                    edges.append((level, at, held))
                elif not edges or edges[-1][0] != level:
                    held = ()
                    edges.append((level, at, held))
                else:
                    held = _with_interval(edges[-1][2], edges[-1][1], at)
                head, body, tail = (coder.encode(p) for p in pieces(role, text.decode()))
                ids.append(head + body + tail)
                low, high = (len(head) // 4, (len(head) + len(body)) // 4) if role == loss_role else (0, 0)
                tokens = len(ids[-1]) // 4
                rows.append((
                    n1, n2, depth, e1, e2, part, at, tokens, outer, [{"start": a, "end": b} for a, b in held], role, low, high
                ))
                at += tokens
                ends[level] = at
            if rows:
                yield common.batch_of(_SEGMENTS, (*zip(*rows), _lists(ids)))

    return run


_FINAL = pa.schema(
    [
        ("n1", pa.int64()), ("n2", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int64()),
        ("position", pa.int64()), ("attends", _INTERVALS), ("role", pa.string()), ("loss_from", pa.int32()),
        ("loss_to", pa.int32()), ("tokens", pa.list_(pa.int32())),
    ]
)
_FINAL_SQL = (
    "n1 long, n2 long, start long, end long, depth long, position long, attends array<struct<start: long, end: long>>, "
    "role string, loss_from int, loss_to int, tokens array<int>"
)


def _attend(bases: dict[int, int], above: dict[int, list[tuple[int, int]]]):
    """Places in the whole stream, positions and ancestors' intervals; every row by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = common.Memo(lambda key: _merged(above.get(key[0], [])[: key[1]]), 10_000)
        for batch in batches:
            rows = []
            for part, local, tokens, outer, own in zip(
                *(batch.column(n).to_pylist() for n in ("part", "local", "n_tokens", "outer", "held"))
            ):
                base, held = bases[part], upper[part, outer]
                for s in own:
                    held = _with_interval(held, base + s["start"], base + s["end"])
                start = base + local
                rows.append((start, start + tokens, sum(b - a for a, b in held), [{"start": a, "end": b} for a, b in held]))
            if rows:
                start, end, position, attends = zip(*rows)
                same = {n: batch.column(n) for n in ("n1", "n2", "depth", "role", "loss_from", "loss_to", "tokens")}
                made = {"start": start, "end": end, "position": position, "attends": attends}
                yield common.batch_of(_FINAL, [(same | made)[f.name] for f in _FINAL])

    return run


def _merged(spans: list[tuple[int, int]]) -> Intervals:
    held: Intervals = ()
    for start, end in spans:
        held = _with_interval(held, start, end)
    return held


def _edges(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """none, conv and the edges of each conversation, as (place, n1, n2) of their first nodes."""
    forks = nodes.filter("depth > 1").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("p1", "p2")
    columns = ["none", "conv", "place", "n1", "n2"]
    tops = turns.filter("place = 1").select(*columns).unionByName(
        lookup_join(turns.filter("place > 1").select(*columns, "p1", "p2"), forks, ["p1", "p2"], "inner").select(*columns)
    )
    return tops.groupBy("none", "conv").agg(F.sort_array(F.collect_list(F.struct("place", "n1", "n2"))).alias("edges"))


def pack(
    conversations: DataFrame, tokenizer: str, loss_role: str = LOSS_ROLE, conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The segments of the stream, and the path of each conversation.

    Segments: n1 and n2 (the node's name), start, end (exclusive), depth, position, attends (ancestors' intervals from
    the root on), role, loss_from and loss_to (within the segment), tokens. Paths: conv_id, place (from 1), n1, n2.

    Turns are ordered by turn, then role and text; null turns come first, null roles and texts are empty. Rows with a
    null conv_id are one conversation. Rows that agree in conversation, turn and the beginning of role and text lie in one
    partition. Two different turns of one name end the job with an error. No rows give no segments.
    """
    conv = F.col(f"`{conv_col}`").cast("long")
    rows = conversations.select(
        conv.isNull().alias("none"), F.coalesce(conv, F.lit(0).cast("long")).alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    starts = [F.substring(name, 1, RANGE_CHARS) for name in ("role", "text")]
    placed = pinned(
        rows.repartitionByRange("none", "conv", "turn", *starts).sortWithinPartitions("none", "conv", "turn", "role", "text")
        .mapInArrow(_place, _PLACED)
    )
    carries = placed.filter("carry").select("part", "none", "conv", "place", "f1", "f2").collect()
    references = placed.filter("NOT carry").select(*[field.split()[0] for field in _REF.split(", ")])
    turns = pinned(references.mapInArrow(_name(_carries(carries)), _NAMED))
    first = F.min(F.struct("none", "conv", "place", "part", "row", "p1", "p2"))
    differs = F.raise_error(F.lit("two different turns have one name"))
    nodes = pinned(
        turns.groupBy("n1", "n2").agg(first.alias("r"), F.min("proof").alias("a"), F.max("proof").alias("b"))
        .select(
            "n1", "n2", F.col("r.place").alias("depth"), "r.none", "r.conv", "r.part",
            F.when(F.col("a") == F.col("b"), F.col("r.row")).otherwise(differs.cast("long")).alias("row"), "r.p1", "r.p2",
        )
    )
    edges = F.filter("edges", lambda e: e["place"] <= F.col("depth"))
    own = F.element_at("levels", -1)
    keyed = nodes.join(_edges(nodes, turns), ["none", "conv"]).select(
        "n1", "n2", "depth", "part", "row", edges.alias("levels")
    ).select(
        "n1", "n2", "depth", "part", "row", "levels", F.size("levels").alias("level"), own["place"].alias("top"),
        own["n1"].alias("e1"), own["n2"].alias("e2"),
    )
    last = F.struct(F.col("depth").alias("place"), *(F.lit(-1).cast("long").alias(n) for n in ("n1", "n2")))
    texts = placed.filter("NOT carry").select("part", "row", "role", "text")
    ordered = texts.join(keyed, ["part", "row"]).withColumn("key", F.concat("levels", F.array(last)))
    columns = ["n1", "n2", "depth", "e1", "e2", "level", "top", "role", "text"]
    encoded = pinned(
        ordered.repartitionByRange("key").sortWithinPartitions("key").select(*columns)
        .mapInArrow(_encode(tokenizer, loss_role), _SEGMENTS_SQL)
    )
    parts = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases = dict(zip([p["part"] for p in parts], [0, *accumulate(p["n"] for p in parts)]))
    above: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(_above(encoded, keyed).collect(), key=lambda r: (r["of"], r["place"])):
        start = bases[r["first"]["part"]] + r["first"]["local"]
        above.setdefault(r["of"], []).append((start, start + r["n"]))
    segments = encoded.mapInArrow(_attend(bases, above), _FINAL_SQL)
    paths = turns.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "place", "n1", "n2")
    return segments, paths


def _above(encoded: DataFrame, keyed: DataFrame) -> DataFrame:
    """Where the edges that lead to the first node of each partition begin, and their tokens before that partition."""
    firsts = encoded.filter("local = 0").select(F.col("part").alias("of"), "n1", "n2")
    wanted = firsts.join(keyed.select("n1", "n2", "levels"), ["n1", "n2"]).select("of", F.explode("levels").alias("e")).select(
        "of", "e.place", F.col("e.n1").alias("e1"), F.col("e.n2").alias("e2")
    )
    found = encoded.select("e1", "e2", "part", "local", "n_tokens").join(wanted, ["e1", "e2"]).filter("part < of")
    return found.groupBy("of", "place").agg(F.min(F.struct("part", "local")).alias("first"), F.sum("n_tokens").alias("n"))


# Reading back

_DECODED = "n1 long, n2 long, turns long, plain string, loss string, chars long, n_tokens long"
_READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long"
)


def _decode(path: str):
    """What each segment says: its turn, and the text under the loss mask."""
    schema = _schema(_DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            rows, tokens = [], batch.column("tokens")
            ids, offsets = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            for a, b, low, high in zip(
                offsets[:-1].tolist(), offsets[1:].tolist(),
                *(batch.column(n).to_pylist() for n in ("loss_from", "loss_to")),
            ):
                formatted = coder.decode(ids[a:b])
                said = parse(formatted)
                loss = unescape(coder.decode(ids[a + low : a + high])) if high > low else ""
                rows.append((len(said), "".join(f"{role}\n{text}\n" for role, text in said), loss, len(formatted), b - a))
            if rows:
                yield common.batch_of(schema, (batch.column("n1"), batch.column("n2"), *zip(*rows)))

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose decoded turns come in order; only the state of one is held."""
    schema, own, state = _schema(_READ), None, None
    for batch in batches:
        done = []
        named = zip(*(batch.column(n).to_pylist() for n in ("none", "conv", "turns", "chars", "n_tokens")))
        for (none, conv, turns, chars, tokens), plain, loss in zip(
            named, common.texts(batch, "plain"), common.texts(batch, "loss")
        ):
            if (none, conv) != own:
                if own is not None:
                    done.append(_finished(own, state))
                own, state = (none, conv), [0, sha256(), 0, sha256(), 0, 0]
            state[1].update(plain)
            state[3].update(loss)
            for i, n in ((0, turns), (2, common.code_points(loss)), (4, chars), (5, tokens)):
                state[i] += n
        if done:
            yield common.batch_of(schema, zip(*done))
    if own is not None:
        yield common.batch_of(schema, zip(_finished(own, state)))


def _finished(own: tuple, state: list) -> tuple:
    turns, plain, chars, loss, formatted, tokens = state
    return (None if own[0] else own[1], turns, plain.hexdigest(), chars, loss.hexdigest(), formatted, tokens)


def read_back(segments: DataFrame, paths: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation as its segments hold it; each segment is decoded once."""
    said = segments.select("n1", "n2", "loss_from", "loss_to", "tokens").mapInArrow(_decode(tokenizer), _DECODED)
    conv = F.col("conv_id")
    turns = paths.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0).cast("long")).alias("conv"), "place", "n1", "n2")
    return (
        turns.join(said, ["n1", "n2"]).select("none", "conv", "place", "turns", "plain", "loss", "chars", "n_tokens")
        .repartition("none", "conv").sortWithinPartitions("none", "conv", "place")
        .mapInArrow(_digest, _READ)
    )
