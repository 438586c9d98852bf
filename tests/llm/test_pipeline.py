"""The pipeline over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from kartotek.llm import decontamination, mixing, simhash
from kartotek.llm.common import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_stages_in_turn(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        held[name] = spark.read.parquet(str(tmp_path / name))
        if name != "token_files":
            assert held[name].columns == columns
        docs = held[name]
    clean, single, safe, mixed, tokens = (held[n] for n, _ in corpus_pipeline.STAGES)
    found = simhash.clusters(single)
    assert found.filter("doc_id <> component_id").count() == 0
    assert single.count() == simhash.clusters(clean).select("component_id").distinct().count()
    assert decontamination.matches(safe, table(spark, FOLDER, "benchmark")).count() == 0
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan(safe).collect()}
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert taken == {i: n for i, n in plan.items() if n}
    assert tokens.count() == mixed.count()
