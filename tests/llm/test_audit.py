"""The filter audit against a brute force that applies the filters one after the other."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np

from kartotek.llm import filter_audit

SPACES = " \t\n\x0b\x0c\r"


def fails(text, doc_id, least):
    spaced = "".join(" " if c in SPACES else c for c in text)
    words = [w for w in spaced.split(" ") if w]
    out = ""
    out += "A" * (len(words) < 50)
    out += "B" * (100 * len(set(words)) < 65 * len(words))
    out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text))
    out += "D" * any(c in "#$%&*|" for c in text)
    out += "E" * (doc_id is not None and text in least and doc_id > least[text])
    return out


def by_hand(rows, labels):
    """rows of (doc_id, text, source), labels of (doc_id, quality, toxic)."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for i, t, s in rows:
        parts[s].append((i, fails(t, i, least)))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == f for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def as_dict(frame):
    return {
        (r["part"], r["filter_order"], r["step"]): [
            r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
        ]
        for r in frame.collect()
    }


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, source string, text string, mask int")


def test_audit_against_brute_force(spark, make):
    draw = random.Random(3)
    pool = ["word", "Other", "ABC", "a|b", "#", "x%", "é", " ", "\x1c"] + [f"w{i}" for i in range(40)]

    def text():
        n = draw.choice([0, 3, 49, 50, 60, 80])
        return "".join(draw.choice(pool[: draw.choice([9, 49])]) + draw.choice([" ", "\n", " \t", "\r\n"]) for _ in range(n))

    rows = [(i, draw.choice([None, ""]) if draw.random() < 0.1 else text(), draw.choice(["a", "b", None, ""])) for i in range(150)]
    rows += [(200 + i, rows[draw.randrange(150)][1], draw.choice("ac")) for i in range(60)]
    rows += [(None, rows[0][1], "a"), (None, rows[0][1], "a"), (None, "", None)]
    rows += [rows[5], (rows[5][0], rows[5][1], "c"), (rows[7][0], rows[8][1], "a"), (-(2**63), rows[9][1], "z"), (2**63 - 1, rows[9][1], "z")]
    rows += [(300, "Aa" * 25_000, "long"), (301, "q " * 20_000, "long")]
    draw.shuffle(rows)
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 210, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = as_dict(filter_audit.filter_audit(make(rows), labels_of(spark, [(*r, "s", "t", 1) for r in labels])))
    assert got == by_hand(rows, labels)


def test_audit_of_odd_and_empty_tables(spark, odd, nothing):
    none = labels_of(spark, [])
    assert filter_audit.filter_audit(nothing, none).collect() == []
    got = as_dict(filter_audit.filter_audit(odd, none))
    assert len(got) == 600 and all(row[4] == row[5] == 0 for row in got.values())


def test_thresholds_are_exact():
    assert filter_audit.text_mask(b" ".join(b"w%d" % i for i in range(50))) == 0
    assert filter_audit.text_mask(b" ".join(b"w%d" % i for i in range(49))) == 1
    many = [b"w%d" % i for i in range(65)]
    assert filter_audit.text_mask(b" ".join(many + many[:35])) == 0
    assert filter_audit.text_mask(b" ".join(many[:64] + many[:36])) == 2
    low = b" ".join(b"w%03d" % i for i in range(60))
    assert filter_audit.text_mask(b"A" * 15 + b" " + low[:-16] + b" " * (300 - len(low))) == 0
    assert filter_audit.text_mask(b"A" * 16 + b" " + low[:-17] + b" " * (300 - len(low))) == 4
    assert filter_audit.text_mask(b"") == 1


def test_chosen_orders_and_own_filters(spark):
    counts = spark.createDataFrame(
        [("p", 1, 3, 1, 0), ("p", 3, 4, 0, 2), ("p", 0, 5, 5, 0), ("p", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long"
    )
    got = as_dict(filter_audit.audit(counts, "XY", ["YX"]))
    assert got == {
        ("p", "YX", 1): [8, 5, 0, 0, 0, 2, 5],
        ("p", "YX", 2): [5, 3, 5, 3, 1, 0, 3],
    }


def test_min_plus_product():
    orders = np.array([[2, 0, 1], [0, 1, 2]])
    assert filter_audit.removal_steps(np.array([0, 1, 6, 7]), orders).tolist() == [[4, 4], [2, 1], [1, 2], [1, 1]]
