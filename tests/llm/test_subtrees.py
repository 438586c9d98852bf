"""Suffix trees of pieces, and maximal repeats with their lengths, against brute force."""

import random

import numpy as np
import pytest

from kartotek.llm import substring_dedup
from tests.llm.test_dedup import words_of


def texts(seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (25, 60, 130)]
    rows = []
    for i in range(40):
        parts = [" ".join(f"w{i}x{rng.randrange(50)}" for _ in range(rng.randrange(30))) for _ in range(3)]
        for at in range(rng.randrange(3)):
            passage = rng.choice(passages).split()
            cut = rng.randrange(len(passage) // 2)
            parts.insert(at, " ".join(passage[cut : cut + rng.randrange(15, 140)]))
        rows.append((i * 3 - 20, "\t".join(parts)))
    return rows + [(500, rows[3][1]), (501, "so " * 60), (502, None), (503, ""), (None, rows[5][1]), (None, rows[5][1])]


def repeats_by_hand(rows, width):
    seen, found = {}, []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words, before = words_of(text), None
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            first = seen.setdefault(key, (i, s))
            if first == (i, s):
                before = None
            elif before == (first[0], first[1] - 1):
                found[-1][2] += 1
                before = first
            else:
                found.append([i, s, width, *first])
                before = first
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("limit", [2, 6, 32_768])
@pytest.mark.parametrize("width", [20, 9])
def test_maximal_repeats(make, limit, width):
    rows = texts(width)
    got = substring_dedup.maximal_repeats(make(rows), width=width, group_limit=limit)
    expected = repeats_by_hand(rows, width)
    assert sorted(map(tuple, got.collect()), key=str) == expected
    assert max(r[2] for r in expected) > 2 * width


def test_lengths_of_each_document(make, nothing):
    rows = texts(4)
    by_id = {}
    for i, _, n, _, _ in repeats_by_hand(rows, 20):
        by_id.setdefault(i, []).append(n)
    got = substring_dedup.substring_digests(make(rows), with_lengths=True).collect()
    assert len(got) == len(rows)
    for r in got:
        lengths = by_id.get(r["doc_id"], [])
        assert (r["n_repeats"], r["longest_repeat"]) == (len(lengths), max(lengths, default=0))
        assert r["n_removed"] >= r["longest_repeat"]
    assert substring_dedup.maximal_repeats(nothing).collect() == []
    assert substring_dedup.substring_digests(nothing, with_lengths=True).collect() == []


def test_leaves_are_sorted_and_share_what_they_say():
    rng = np.random.default_rng(3)
    for depth in (7, 20):
        lengths = rng.integers(depth, 2 * depth, size=60)
        words = rng.integers(0, 2, size=lengths.sum()).astype(np.uint64)
        pieces = np.split(words, np.cumsum(lengths)[:-1])
        places = [(p, s) for p, n in enumerate(lengths) for s in range(n - depth + 1)]
        owner, within = (np.array(c) for c in zip(*places))
        order, shared = substring_dedup.leaves(words, lengths, owner, within, depth)
        assert sorted(order.tolist()) == list(range(len(places)))
        suffixes = [pieces[p][s:].tolist() for p, s in (places[i] for i in order)]
        for left, right, n in zip(suffixes, suffixes[1:], shared.tolist()):
            same = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))
            assert n == same
            assert n == len(left) or n == len(right) or left[n] < right[n]
