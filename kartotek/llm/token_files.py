"""Documents as flat files of token ids.

A folder holds, for each partition in ascending order of documents, three flat little-endian files:

* ``.bin``: the ids of all its documents, unsigned 16-bit where the vocabulary allows it, else 32-bit;
* ``.off``: unsigned 64-bit offsets of its documents within the file, one more than documents;
* ``.doc``: signed 64-bit document ids (a null id is the smallest 64-bit integer).

``manifest.json`` names the files and gives each partition's base, the number of ids in all files before it; base
plus offset is a document's place in the whole. The bases are prefix sums of one count per partition, the only
thing that reaches the driver. Files are read by memory map where the folder is a local path.

A task writes files of its own name, and only those of the attempts that succeeded are in the manifest, so a
repeated or lost task does no harm.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartotek.llm import common

CACHE_WORDS = 300_000
NULL_ID = -(1 << 63)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; without a scheme it is a local path."""
    if ":" not in uri.split("/")[0]:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class _Words(dict):
    """Ids of words, worked out when first asked for; emptied when it has grown to its limit."""

    def __init__(self, encode: Callable[[bytes], bytes], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = self.encode(word)
        return found


# The one form of normaliser and pre-tokeniser under which words can be encoded apart
_APART_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ],
}
_APART_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True,
}
_APART_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def allows_words_apart(definition: str) -> bool:
    """Whether a tokenizer's definition proves that the ids of a text are those of its words, one after the other."""
    held = json.loads(definition)
    splits = (held.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        held.get("normalizer") == _APART_NORMALIZER
        and len(splits) == 2
        and splits[0] == _APART_SPLIT
        and {k: v for k, v in splits[1].items() if k != "trim_offsets"} == _APART_BYTES
        and held.get("model", {}).get("type") == "BPE"
        and not held.get("truncation")
        and not held.get("padding")
        and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in held.get("added_tokens", []))
    )


class Encoder:
    """Ids of texts by a tokenizer file of the ``tokenizers`` library.

    With ``words_apart``, words are encoded once and kept in a cache of bounded size, if the file says that the tokenizer
    drops white space, folds case and treats runs of letters, single digits and runs of other marks by themselves, as
    byte-level BPE. Otherwise, or without ``words_apart``, whole texts are encoded.
    """

    def __init__(self, path: str, words_apart: bool = True, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words_apart = words_apart and allows_words_apart(self.tokenizer.to_str())
        self.words = _Words(self._word, cache_words)
        self.bytes = _byte_letters()

    def _plain(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _word(self, word: bytes) -> bytes:
        """A word is its letters followed by its marks; anything else goes through the whole tokenizer."""
        core = word.rstrip(b".,;:!?|")
        if not core:
            return self._plain(word)
        if len(core) < len(word) and core[-1:].isalnum():
            return self.words[core] + self.words[word[len(core) :]]
        if len(core) == len(word):
            text = word.lower().decode() if word.isascii() else word.decode()
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                letters = text if word.isascii() else "".join(map(self.bytes.__getitem__, word))
                return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], dtype=self.kind).tobytes()
        return self._plain(word)

    def encode(self, text: bytes) -> bytes:
        if not self.words_apart:
            return self._plain(text) if text else b""
        return b"".join(map(self.words.__getitem__, text.split()))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be printed, else 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str, words_apart: bool = True) -> Encoder:
    """One encoder a process, so that its cache outlives a task."""
    return Encoder(path, words_apart)


def _write(folder: str, tokenizer: str, end_id: int, words_apart: bool):
    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, root = filesystem(folder)
        words = encoder(tokenizer, words_apart)
        end = np.array([end_id], dtype=words.kind).tobytes()
        docs = tokens = 0
        with (
            files.open_output_stream(f"{root}/{name}.bin") as ids_out,
            files.open_output_stream(f"{root}/{name}.off") as offsets_out,
            files.open_output_stream(f"{root}/{name}.doc") as docs_out,
        ):
            offsets_out.write(np.zeros(1, dtype="<u8").tobytes())
            for batch in batches:
                counts = []
                for text in common.texts(batch):
                    ids = words.encode(text) + end
                    ids_out.write(ids)
                    counts.append(len(ids) // words.kind.itemsize)
                ends = tokens + np.cumsum(np.array(counts, dtype="<u8"))
                offsets_out.write(ends.astype("<u8").tobytes())
                docs_out.write(batch.column("doc_id").fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
                docs += len(counts)
                tokens += sum(counts)
        yield common.batch_of(schema, ([task.partitionId()], [name], [docs], [tokens]))

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    words_apart: bool = True,
) -> dict:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of ids; returns the manifest.

    A null text is empty and a null id comes first; rows that share an id are ordered by a hash of their text. No
    rows give a manifest without documents.
    """
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = common.id_and_text(docs, id_col, text_col).withColumn("__tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    parts = ordered.mapInArrow(
        _write(folder, tokenizer, end_id, words_apart), "part int, name string, n_docs long, n_tokens long"
    ).collect()
    parts = sorted((p for p in parts if p["n_docs"]), key=lambda p: p["part"])
    bases = [0, *accumulate(p["n_tokens"] for p in parts)]
    manifest = {
        "kind": encoder(tokenizer, words_apart).kind.str,
        "end_id": end_id,
        "n_tokens": bases[-1],
        "parts": [
            {"name": p["name"], "base": b, "n_docs": p["n_docs"], "n_tokens": p["n_tokens"]} for p, b in zip(parts, bases)
        ],
    }
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def mapped(uri: str, kind: str) -> np.ndarray:
    """A flat file as an array: a memory map of a local file, else its bytes."""
    files, path = filesystem(uri)
    if isinstance(files, pafs.LocalFileSystem):
        import os

        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
    with files.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=kind)


def read_manifest(folder: str) -> dict:
    files, root = filesystem(folder)
    with files.open_input_file(f"{root}/manifest.json") as source:
        return json.loads(source.read())


def documents_of(folder: str, kind: str, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Id, place within the partition and token ids of each document of one partition."""
    ids, offsets = mapped(f"{folder}/{name}.bin", kind), mapped(f"{folder}/{name}.off", "<u8")
    docs = mapped(f"{folder}/{name}.doc", "<i8")
    for i, doc in enumerate(docs.tolist()):
        start, end = int(offsets[i]), int(offsets[i + 1])
        yield (None if doc == NULL_ID else doc), start, ids[start:end]


def _read(folder: str, kind: str):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                rows = []
                for doc, start, ids in documents_of(folder, kind, name):
                    rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield common.batch_of(schema, zip(*rows))
                        rows = []
                if rows:
                    yield common.batch_of(schema, zip(*rows))

    return run


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as unsigned 32-bit integers."""
    manifest = read_manifest(folder)
    parts = manifest["parts"]
    names = spark.createDataFrame([(p["name"], p["base"]) for p in parts], "name string, base long")
    if parts:
        names = names.repartition(len(parts))
    return names.mapInArrow(_read(folder, manifest["kind"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
