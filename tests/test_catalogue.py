from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from tests import oracle

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_same_as_sql(spark, connection, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    assert oracle.differences(frame, connection, entry_point.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_gives_rows(spark, name):
    assert entry_point.queries()[name](spark, FOLDER).count() > 0
