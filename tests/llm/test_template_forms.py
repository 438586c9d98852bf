"""Decontamination in all forms: number words, glued units, items of few words; all of it against brute force."""

from __future__ import annotations

import math
import random
import re

from kartotek.llm import decontamination as d

ITEM = "If Alice had 12 apples and gave Bob 5 of them at 9 am then how many apples would Alice still have"


def found(spark, make, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.matches(make(docs), bench, all_forms=True).collect()
    return {(r["doc_id"], r["item_id"]): (r["windows"], r["found"], r["kind"]) for r in rows}


def test_number_words_and_glued_units(spark, make):
    docs = [
        (1, ITEM.replace("12", "twelve").replace("5", "forty-one")), (2, ITEM.replace("9 am", "9am")),
        (3, ITEM.replace("9 am", "10pm").replace("12", "Eleven")), (4, "nine am and 9am of 12 apples"),
    ]
    got = found(spark, make, docs, [(1, ITEM), (2, ITEM.replace("9 am", "9am") + " now")])
    assert {k: v[2] for k, v in got.items() if k[1] == 1} == {(1, 1): "reparameterised", (2, 1): "exact", (3, 1): "reparameterised"}


def test_items_of_few_words_take_nothing_out(spark, make):
    docs = [(1, "please summarize this text"), (2, f"so: {ITEM}"), (3, "name two primes now"), (4, "2 + 2")]
    bench = spark.createDataFrame([(1, "Summarize"), (2, ITEM), (3, "Name two primes"), (None, "2 + 2"), (5, None)], "item_id long, text string")
    assert {r["item_id"] for r in d.few_words(bench).collect()} == {1, None, 5}
    assert {r["doc_id"] for r in d.decontaminate(make(docs), bench, all_forms=True).collect()} == {1, 4}
    assert {r["doc_id"] for r in d.decontaminate(make(docs), bench, all_forms=True, least_words=1).collect()} == set()


def readings(text):
    text = re.sub("([0-9])((?i:" + "|".join((*d.UNITS, *d.CLOCK)) + "))(?![A-Za-z0-9])", r"\1 \2", text)
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    bare = [w.strip(d.MARKS) for w in words]
    cores = [w.lower() for w in bare]
    number = lambda i: i >= 0 and "0" <= cores[i][:1] <= "9"
    spelt = lambda i: number(i) or i >= 0 and cores[i] in d.NUMBER_WORDS
    capital = lambda i: bare[i][:1] != cores[i][:1]
    loud = lambda i: not 0 <= i < len(bare) or bare[i] == bare[i].upper()
    strict, folded, named = [], [], []
    for i, w in enumerate(cores):
        strict.append(
            "<num>" if number(i) else w if i == 0 or not w else "<unit>" if number(i - 1) and w in d.UNITS
            else "<name>" if capital(i) and words[i - 1][-1] not in d.SENTENCE_ENDS else w
        )
        folded.append("<num>" if spelt(i) else "<unit>" if w in (*d.UNITS, *d.CLOCK) and spelt(i - 1) else w)
        plain = folded[-1]
        quiet = not plain or plain.startswith("<") or not capital(i) or (loud(i - 1) and loud(i) and loud(i + 1))
        named.append(plain if quiet else "<name>")
    return cores, [strict, folded, named]


def content(window):
    return sum(w != "" and not w.startswith("<") for w in window)


def windows(form):
    return {i: tuple(form[i : i + d.WORDS]) for i in range(len(form) - d.WORDS + 1)}


def by_hand(doc, item):
    """Windows, windows found and kind of an item in a document, or None; for items with many windows only."""
    i_cores, i_forms = readings(item)
    basis = next((f for f in i_forms[:2] if any(content(w) >= d.CONTENT for w in windows(f).values())), None)
    counted = [i for i, w in windows(basis).items() if content(w) >= d.CONTENT]
    cores, forms = readings(doc)
    hits = set()
    for form in i_forms:
        for i in counted:
            shape = windows(form)[i]
            if content(shape) >= d.LEAST_CONTENT:
                hits |= {(i, p, shape) for own in forms for p, w in windows(own).items() if w == shape}
    need, held = math.ceil(len(counted) * d.SHARE_PERCENT / 100), len({i for i, *_ in hits})
    if held * 100 < len(counted) * d.SHARE_PERCENT:
        return None
    lines = {}
    for i, p, shape in hits:
        lines.setdefault(p - i, set()).add((i, p, shape))
    most = max(len({i for i, *_ in line}) for line in lines.values())
    kinds = []
    for line in lines.values():
        if len({i for i, *_ in line}) < min(need, most):
            continue
        slots = {(s, i_cores[i + k], cores[p + k]) for i, p, shape in line for k, s in enumerate(shape) if s.startswith("<")}
        names = {(a, b) for s, a, b in slots if s == "<name>"}
        if len(names) == len({a for a, _ in names}) == len({b for _, b in names}):
            kinds.append("reparameterised" if any(a != b for _, a, b in slots) else "exact")
    return (len(counted), held, min(kinds)) if kinds else None


def test_all_forms_against_brute_force(spark, make):
    draw = random.Random(3)
    swaps = {
        "Alice": ["Alice", "Clara", "ALICE", "alice"], "Bob": ["Bob", "Dan", "Clara"], "12": ["12", "7", "seven", "5"],
        "5": ["5", "five", "12"], "9 am": ["9 am", "9am", "10 pm", "ten am"], "many": ["many", "few"], "then": ["then", "then,", "so"],
    }
    docs = []
    for n in range(120):
        text = ITEM
        for old, new in swaps.items():
            if draw.random() < 0.6:
                text = text.replace(old, draw.choice(new), draw.choice([1, -1]))
        text = draw.choice(["{}", "Well. {}", "some words {} and more", "{0} {1}", "{}."]).format(text, ITEM)
        docs.append((n, draw.choice([text, text, text.upper(), text.lower()])))
    other = "Once upon a time 3 kings rode 40 km to Paris and met 2 queens there who sold them seven horses for 90 euros"
    docs += [(500 + i, t) for i, t in enumerate([other, other.replace("40 km", "8miles").replace("Paris", "Rome"), "", "Alice"])]
    items = [(1, ITEM), (2, other)]
    want = {(i, k): v for i, text in docs for k, item in items if (v := by_hand(text, item))}
    assert found(spark, make, docs, items) == want
    assert 40 < len(want) < len(docs) * 2
