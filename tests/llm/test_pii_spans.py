"""Added spans of personal data: planted values of every kind, found without the values that only look like them."""

from __future__ import annotations

import random

import pytest

from kartotek.llm import pii

WORDS = "the of and report meeting river garden window story lantern quiet paper number bread seven dot matrix".split()


def luhn_number(draw, length, good=True):
    while True:
        digits = "4" + "".join(draw.choices("0123456789", k=length - 1))
        if pii.luhn(digits) == good and len(set(digits)) > 4:
            return digits


def planted(draw):
    """Kind, value and lead of personal data that no strict pattern finds, then of values that are none."""
    card = luhn_number(draw, 16)
    four = [card[i : i + 4] for i in range(0, 16, 4)]
    pairs = " ".join(f"{draw.randrange(100):02d}" for _ in range(4))
    yes = [
        ("email", f"anna.{draw.randrange(999)} at mail{draw.randrange(9)} dot example dot com", "write to"),
        ("email", f"bo{draw.randrange(999)}[at]example[.]org", "mail"),
        ("ip", ".".join(str(draw.randrange(1, 255)) for _ in range(4)).replace(".", "[.]"), "server"),
        ("card", "/".join(four), "card"),
        ("phone", f"06 {pairs}", "call"),
        ("phone", f"(030) {draw.randrange(10**6, 10**7)}", "phone"),
        ("secret", "".join(draw.choices("0123456789abcdef", k=240)), "token"),
    ]
    no = [
        ("card", luhn_number(draw, 16, good=False), "the"),
        ("ip", f"{draw.randrange(300, 999)}[.]{draw.randrange(300, 999)}[.]7[.]1", "version"),
        ("secret", "internationalization" * 2 + "1", "the"),
        ("phone", "02.03.2021 1145", "on"),
    ]
    return yes, no


@pytest.fixture(scope="module")
def texts():
    draw, rows, yes, no = random.Random(11), [], {}, {}
    for i in range(240):
        good, bad = planted(draw)
        before, after = (" ".join(draw.choices(WORDS, k=6)) for _ in range(2))
        if i % 3 == 0:
            kind, value, lead = good[(i // 3) % len(good)]
            rows.append((i, f"{before} {lead} {value} , {after}"))
            yes[i] = f"{kind}:{rows[-1][1].index(value)}:{rows[-1][1].index(value) + len(value)}"
        elif i % 3 == 1:
            kind, value, lead = bad[(i // 3) % len(bad)]
            rows.append((i, f"{before} {lead} {value} , {after}"))
            no[i] = value
        else:
            base = draw.choice(["x.y@mail.com", "+1 (212) 555-0142", "10.1.2.3", luhn_number(draw, 16)])
            rows.append((i, f"{before} mail {base} , {after}"))
    return rows, yes, no


def test_planted_spans(make, texts):
    rows, yes, no = texts
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.find(make(rows)).collect()}
    for kind in pii.KINDS:
        own = [i for i, span in yes.items() if span.startswith(kind)]
        assert own and sum(yes[i] in got[i] for i in own) >= 0.9 * len(own), kind
    wrong = sum(bool(got[i]) for i in no)
    assert wrong <= 0.1 * len(no)


def test_one_failing_number_is_no_card(make):
    spans = [r["spans"] for r in pii.find(make([(1, "By 5693240340017844 was"), (2, "the 4111111111111111 of")])).collect()]
    assert sorted(spans) == ["", "card:4:20"]


def test_few_spans_and_none():
    assert pii.accepted_codes([]) == set()
    base = pii.code_of([1, 1, 1, 0, 1], [0, 0, 1, 0])
    assert (0, base) in pii.accepted_codes([(0, base, 1)])


@pytest.mark.parametrize("text", ["a" * 300_000, "0" * 300_000, "a0" * 150_000, "a at " * 60_000, "01 " * 100_000, "1[.]" * 80_000, "a dot " * 50_000 + "at"])
def test_long_runs_cost_no_squares(text):
    pii._spans_of(text)


def test_words_before_are_whole():
    text = "secret " + "x" * 500 + " - " * 100 + "is 5"
    assert pii._words_before(text, len(text) - 1) == ["-", "-", "is"] or pii._words_before(text, len(text) - 1)[-1] == "is"
    assert pii._words_before("password  " + " " * 400, 410) == ["password"]
