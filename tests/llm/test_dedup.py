"""Line, exact, substring and near duplicates against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from kartotek.llm import bloom, exact_dedup, graph, line_dedup, simhash, substring_dedup

from .conftest import ODD

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().split()


def sample(seed, docs=60, words=120, vocabulary=25):
    """Texts of a small vocabulary that share passages."""
    draw = random.Random(seed)
    passage = [f"p{draw.randrange(40)}" for _ in range(90)]
    out = []
    for doc in range(docs):
        text = [f"w{draw.randrange(vocabulary)}{draw.randrange(30)}" for _ in range(draw.randrange(words))]
        if draw.random() < 0.5:
            a = draw.randrange(60)
            text[10:10] = passage[a : a + draw.randrange(5, 60)]
        out.append((doc, draw.choice([" ", "\n", "  "]).join(text)))
    return out + [(docs + i, out[draw.randrange(docs)][1]) for i in range(5)]


def test_lines_by_hand(make):
    shared = "This is a line of some length"
    rows = [
        (1, f"{shared}\nown one"), (2, f"own two\n  {shared.upper()}\t\n{shared}"), (3, f"{shared}\n{shared}\n"),
        (4, "short\nshort"), (5, "short"), (6, "short"), (7, None),
    ]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(make(rows)).collect()}
    assert got == {
        1: (2, 1, "own one"), 2: (3, 2, "own two"), 3: (3, 0, f"{shared}\n{shared}\n"), 4: (2, 0, "short\nshort"),
        5: (1, 0, "short"), 6: (1, 0, "short"), 7: (1, 0, ""),
    }


def test_line_of_every_document_stays_once(make):
    line = "a line that each and every document holds"
    got = line_dedup.line_dedup(make([(i, f"{line}\n{i}") for i in range(300)]))
    assert got.filter("n_dropped = 0").select("doc_id").collect() == [(299,)]


def test_lines_of_odd_rows(odd, nothing):
    got = line_dedup.line_digests(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    assert {r["kept_sha256"] for r in got} == {sha256((t or "").encode()).hexdigest() for _, t in ODD}
    assert line_dedup.line_digests(nothing).collect() == []


def test_lines_of_repeated_ids_count_documents(make):
    line = "a line that is found in several rows"
    rows = [(1, line), (1, line), (2, line), (3, "own"), (None, line + " too"), (None, line + " too"), (None, line + " too")]
    assert [r["n_dropped"] for r in line_dedup.line_dedup(make(rows)).collect()] == [0] * 7
    more = line_dedup.line_dedup(make(rows + [(-(2**63), line), (None, line)])).collect()
    assert Counter((r["doc_id"], r["n_dropped"]) for r in more) == Counter(
        [(1, 1), (1, 1), (2, 0), (3, 0), (-(2**63), 1), (None, 1)] + [(None, 0)] * 3
    )


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, text in rows:
        plain = "".join(c for c in text or "" if c not in SPACE)
        groups[plain].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for plain, members in groups.items():
        keep = min(members)
        out += [(m[3], keep[3], len(members), m == keep, sha256(plain.encode()).hexdigest()) for m in members]
    return Counter(out)


@pytest.mark.parametrize("max_bits", [1 << 10, bloom.MAX_BITS])
def test_exact_copies(make, max_bits):
    rows = sample(1) + ODD + [(900 + i, "a b  c") for i in range(50)] + [(800, "ab c\n\n")]
    rows += [(-(2**63), "least"), (2**63 - 1, "least"), (-(2**63), "lea st"), (None, "lea  st")]
    got = Counter(tuple(r) for r in exact_dedup.decisions(make(rows), max_bits=max_bits).collect())
    assert got == exact_by_hand(rows)


def test_exact_dedup_keeps_columns(make, nothing):
    kept = exact_dedup.exact_dedup(make([(1, "a"), (2, "a "), (3, None), (None, "")]))
    assert sorted((r["doc_id"], r["kept"], r["a.b"]) for r in kept.collect()) == [(2, "k", "x"), (3, "k", "x")]
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_filter_never_misses_a_repeat(spark):
    keys = [7, 7, *range(100, 400), 250]
    found = bloom.build(spark.createDataFrame([(k,) for k in keys], "h long").repartition(5), 1 << 12, twice=True)
    assert bloom.contains(found, np.array([7, 250])).all()
    every = bloom.build(spark.createDataFrame([(k,) for k in keys], "h long").repartition(5), 1 << 14)
    assert bloom.contains(every, np.array(keys)).all()
    assert bloom.contains(every, np.arange(10_000, 20_000)).mean() < 0.1


def substrings_by_hand(rows, width):
    seen, out = set(), []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words, gone = words_of(text), set()
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            if key in seen:
                gone.update(range(s, s + width))
            seen.add(key)
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out += [(i, len(words), len(gone), sha256(kept).hexdigest())] * rows.count((i, text))
    return Counter(out)


@pytest.mark.parametrize("limit", [2, 6, 32_768])
@pytest.mark.parametrize("width", [20, 7])
def test_repeated_passages(make, limit, width):
    rows = sample(2) + ODD + [(700, "again " * 45), (701, "again " * 70)]
    got = substring_dedup.substring_digests(make(rows), width=width, group_limit=limit)
    assert Counter(tuple(r) for r in got.collect()) == substrings_by_hand(rows, width)


def test_repeated_passage_of_all_documents(make):
    passage = " ".join(f"p{i}" for i in range(55))
    got = substring_dedup.substring_dedup(make([(i, f"own{i} {passage} end{i}") for i in range(40)]), group_limit=10)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[0] == f"own0 {passage} end0"
    assert all(texts[i] == f"own{i} end{i}" for i in range(1, 40))


def test_full_filter_gives_the_same(make, nothing):
    rows = sample(3)
    got = substring_dedup.substring_digests(make(rows), max_bits=1 << 10)
    assert Counter(tuple(r) for r in got.collect()) == substrings_by_hand(rows, 20)
    assert substring_dedup.substring_digests(nothing).collect() == []


def fingerprint_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows):
    prints = [fingerprint_by_hand(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, prints[i], min(ids, default=None)))
    return Counter(out)


def near_copies(seed, docs=50, copies=6):
    draw = random.Random(seed)
    out = []
    for d in range(docs):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([2, 30, 200, 400]))]
        for c in range(copies):
            out.append((d * copies + c, " ".join(words)))
            words[draw.randrange(len(words))] = f"x{draw.randrange(400)}"
    return out


@pytest.mark.parametrize("node_limit", [4_096, 1])
def test_near_copies(make, node_limit):
    rows = near_copies(4) + ODD
    found = simhash.clusters(make(rows), node_limit=node_limit).collect()
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in found) == components_by_hand(rows)


def test_simhash_dedup_keeps_one_of_each(make, nothing):
    rows = near_copies(5, 10)
    parts = {c for _, _, c in components_by_hand(rows)}
    kept = simhash.simhash_dedup(make(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(parts)
    assert kept.columns == make([]).columns
    assert simhash.clusters(nothing).collect() == []


@pytest.mark.parametrize("deeper", [0, 3])
def test_trie_join_finds_all_links(deeper):
    draw = np.random.default_rng(deeper)
    base = draw.integers(0, 2**63, 20, dtype=np.uint64)
    bits = {int(b) ^ sum({1 << int(k) for k in draw.integers(0, 64, draw.integers(0, 4))}) for b in base for _ in range(20)}
    bits = np.array(sorted(bits), dtype=np.uint64)
    zero = np.zeros(len(bits), dtype=np.int64)
    root = simhash.join_units(zero, zero, bits)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2
    label = np.arange(len(bits))
    while (better := np.where(near, label[None, :], len(bits)).min(axis=1)).tolist() != label.tolist():
        label = better
    assert root.tolist() == label.tolist()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(500, 500), (-3, -9), (-9, -20)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)} | {-3: -20, -9: -20}
