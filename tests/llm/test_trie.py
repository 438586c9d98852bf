"""The prefix trie against a brute force over rebuilt texts."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from kartotek.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, f1 long, `a.b` string, part string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            whole = sha256(b"%d:%b%b" % (len(role.encode()), role.encode(), text.encode())).digest()
            tie = tuple(int.from_bytes(whole[i : i + 8], "little", signed=True) for i in (16, 24))
            turns[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    plain = {c: [t for _, t in sorted(held)] for c, held in turns.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = plain.get(base, [])[:h] + own[h:]
    return out


def by_hand(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), leaves[node],
            saved[node], sha256(",".join(map(str, sorted(c for c in held if len(convs[c]) == len(node)))).encode()).hexdigest(),
        )
        for node, held in members.items()
    )


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def figures(frame):
    return sorted(tuple(r[n] for n in NAMES) for r in frame.collect())


def made(seed, convs, longest):
    draw = random.Random(seed)
    pool = [("user", "hello"), ("assistant", "hé 😀"), ("user", None), (None, ""), ("user", "x" * 30), ("", "hello")]
    rows = []
    for c in draw.sample([-250, -100, -7, -1, *range(0, 520)], convs):
        shift = draw.choice([0, 5, -3])
        for t in range(draw.randrange(1, longest)):
            role, text = draw.choice(pool[: draw.choice([1, 2, 6])])
            rows.append((c, None if draw.random() < 0.05 else draw.choice([t, t, t - t % 2]) + shift, role, text))
    rows += [rows[3], rows[3], (None, 0, "user", "of no conversation"), (None, None, None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_trie_against_brute_force(spark, seed):
    rows = made(seed, 150, [3, 9, 15, 30][seed])
    assert figures(prefix_trie.trie_digests(conversations(spark, rows))) == by_hand(rows)


def test_small_blocks_and_pieces_give_the_same(spark, monkeypatch):
    rows = made(9, 120, 20)
    monkeypatch.setattr(prefix_trie, "DEPTH_BLOCK", 3)
    assert figures(prefix_trie.trie_digests(conversations(spark, rows))) == by_hand(rows)
    ends = [(c, 0, 1, 1) for c in range(-5, 40)]
    frame = spark.createDataFrame(ends, "conv_id long, depth long, f1 long, f2 long")
    expected = sha256(",".join(str(c) for c in range(-5, 40)).encode()).hexdigest()
    assert [r["ends_sha256"] for r in prefix_trie.end_digests(frame).collect()] == [expected]


def test_a_long_conversation_lies_in_many_partitions(spark):
    rows = [(c, t, "user", f"turn {t % 7}") for c in (3, 100, 103) for t in range(9_000 if c != 3 else 4)]
    got = prefix_trie.ordered_turns(conversations(spark, rows))
    assert got.filter("conv_id = 100").select("f1").distinct().count() == 9_000
    places = [r["place"] for r in got.filter("conv_id = 103").orderBy("place").collect()]
    assert places == list(range(1, 9_001))
    whole = figures(prefix_trie.trie_digests(conversations(spark, rows)))
    held = [r for r in whole if r[1] == 9_000]
    assert [(r[0], r[3], r[4]) for r in held] == [(100, 2, 0)]
    assert max(r[1] for r in whole) == 9_000 and whole[-1][2] in (100, 3)


def test_references_give_the_turns(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"{c % 2} {t}") for c in range(100, 130) for t in range(7)]
    frame = conversations(spark, rows)
    nodes = prefix_trie.prefix_trie(frame).nodes.collect()
    turns, convs = defaultdict(list), rebuilt(rows)
    for c, _, role, text in sorted(rows):
        turns[c].append((role, text))
    for n in nodes:
        if n["depth"]:
            assert turns[n["turn_conv"]][n["turn_place"] - 1] == convs[n["conv_id"]][n["depth"] - 1]


def test_no_rows_and_nothing_left(spark):
    assert prefix_trie.trie_digests(conversations(spark, [])).collect() == []
    one = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 == 2)
    got = figures(prefix_trie.trie_digests(conversations(spark, [(one, 0, "user", "a")])))
    assert got == [(one, 0, None, 1, 0, 1, 0, sha256(str(one).encode()).hexdigest())]


def test_fingerprints_that_meet_by_chance_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_turns", blind(prefix_trie._turns))
    rows = [(c, t, "user", f"{c}") for c in (1, 2) for t in range(6)]
    with pytest.raises(Exception, match="fingerprints meet by chance"):
        prefix_trie.trie_digests(conversations(spark, rows)).collect()


def blind(turns):
    def run(batches):
        for batch in turns(batches):
            nothing = np.zeros(batch.num_rows, dtype=np.int64)
            for name in ("e1", "e2"):
                i = batch.schema.get_field_index(name)
                batch = batch.set_column(i, batch.schema.field(i), [nothing][0])
            yield batch

    return run


def test_products_modulo_the_prime():
    draw = random.Random(5)
    p = prefix_trie.PRIME
    a = [0, 1, p - 1, p - 1, *(draw.randrange(p) for _ in range(500))]
    b = [p - 1, 1, p - 1, 2, *(draw.randrange(p) for _ in range(500))]
    assert prefix_trie.times(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)).tolist() == [x * y % p for x, y in zip(a, b)]
    exponents = [0, 1, 2, 1_000_003]
    assert prefix_trie.power(7, np.array(exponents)).tolist() == [pow(7, e, p) for e in exponents]
