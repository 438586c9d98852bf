"""The compressed prefix tree of chat formatting: long conversations, many forks, hot ids, and the codec."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
import public_tokenizers

from kartotek.llm import chat
from tests.llm.test_corpus import chats_by_hand

BYTE_PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def packed(spark, rows):
    segments, paths = chat.pack(spark.createDataFrame(rows, SCHEMA), BYTE_PATH)
    got = {r[0]: tuple(r[1:5]) for r in chat.read_back(segments, paths, BYTE_PATH).collect()}
    return sorted(segments.collect(), key=lambda r: r["start"]), got


def test_long_conversation_and_a_copy_that_leaves_it_late(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"t{t}" if t != 2_500 or c < 2 else "other") for c in (1, 2) for t in range(3_000)]
    rows += [(None, t, "assistant", f"n{t}") for t in range(3_000)]
    held, got = packed(spark, rows)
    assert got == chats_by_hand(rows)
    assert len(held) == 3_000 + 500 + 3_000
    assert [r["start"] for r in held[1:]] == [r["end"] for r in held[:-1]] and held[0]["start"] == 0
    ends = {r["start"]: r for r in held}
    for r in held:
        assert len(r["attends"]) <= 2
        assert r["position"] == sum(b - a for a, b in r["attends"])
        assert all(a in ends for a, _ in r["attends"])


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_a_fork_at_every_depth(spark, parts, monkeypatch):
    order = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, *c: order(self, parts, *c))
    rows = [(c, t, "user", "a" if t < c else f"leaf {c}") for c in range(40) for t in range(c + 1)]
    rows += [(100 + c, t, "user", "a" if t < c else f"more {c} {t}") for c in range(0, 40, 3) for t in range(c + 3)]
    held, got = packed(spark, rows)
    assert got == chats_by_hand(rows)
    stack = []
    for r in held:
        stack = stack[: r["depth"] - 1]
        assert r["position"] == sum(b - a for a, b in stack)
        covered = {x for a, b in r["attends"] for x in range(a, b)}
        assert covered == {x for a, b in stack for x in range(a, b)}
        stack.append((r["start"], r["end"]))


@pytest.mark.parametrize("path", [BYTE_PATH, WORD_PATH])
def test_codec_agrees_with_the_tokenizer(path):
    coder, draw = chat.Codec(path), random.Random(5)
    letters = list("ab zZ09'.,!\n\t \x0b\x1c\x00\x85\xa0éßŁǅ²½—“…·日本\U0001f600́") + ["'s", "'ll", "  ", "<|endoftext|>", "der ", " été"]
    for _ in range(3_000):
        text = "".join(draw.choices(letters, k=draw.randrange(12)))
        ids = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), dtype="<i4").tolist() == ids, repr(text)
        if path == BYTE_PATH:
            assert coder.decode(np.array(ids, dtype=np.int32)) == text
    assert coder.by_piece == (path == BYTE_PATH)


def test_small_caches_change_nothing():
    few, many = chat.Codec(BYTE_PATH, cache_pieces=2), chat.Codec(BYTE_PATH)
    text = "one two three one two, three.\n" * 20
    assert few.encode(text) == many.encode(text)


def test_turnless_texts_and_repeated_rows(spark):
    rows = [(1, None, None, None)] * 3 + [(2, 5, "assistant", "")] * 2 + [(3, 1, "assistant", "x" * 200_000)]
    held, got = packed(spark, rows)
    assert got == chats_by_hand(rows)
    assert got[2][2:] == (0, sha256(b"").hexdigest())
    assert len(held) == 3 + 2 + 1
