from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `__doc` long, `a.b` string"


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source), with further columns whose names the operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "k", 1, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def make(spark):
    return lambda rows: documents(spark, rows)


ODD = [
    (None, "a null id has a text as well"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "x" * 50_000),
    (5, "w " * 20_000), (6, "the same row"), (6, "the same row"), (7, "Ärger mit Ümläuten und mehr\n\nÉtat"),
    (8, "\u0000 odd \u001c signs \U0001f600"),
]


@pytest.fixture
def odd(make):
    return make(ODD)


@pytest.fixture
def nothing(make):
    return make([])
