"""Random inputs against plain Python, a whole batch per Spark job."""

from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kartotek.functions import text, vector
from kartotek.operators import cleaning, histograms, sampling

relaxed = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)
plain_text = st.text(alphabet=st.sampled_from("aAøØ 019_-\t\n"), max_size=12)


@relaxed
@given(st.lists(plain_text, min_size=1, max_size=60))
def test_text_functions(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "t string")
    got = frame.select(text.first_number(F.col("t")), text.squeezed_lower(F.col("t")), text.words(F.col("t"))).collect()
    for v, (number, squeezed, found) in zip(values, got):
        digits = re.search("[0-9]+", v)
        expected = int(digits[0]) if digits and int(digits[0]) < 2**31 else None
        assert (number, squeezed, found) == (expected, re.sub(r"\s+", "", v.lower()), v.lower().split())


number = st.floats(-1e6, 1e6)


@relaxed
@given(st.lists(st.tuples(st.lists(number, min_size=3, max_size=3), st.lists(number, min_size=3, max_size=3)), min_size=1, max_size=40))
def test_abs_difference(spark, pairs):
    frame = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in frame.select(vector.abs_difference(F.col("a"), F.col("b"))).collect()]
    assert got == [[abs(x - y) for x, y in zip(a, b)] for a, b in pairs]


@relaxed
@given(st.lists(st.one_of(st.none(), st.integers(-1000, 1000)), min_size=1, max_size=60))
def test_imputed_mean(spark, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
    present = [v for v in values if v is not None]
    mean = sum(present) / len(present) if present else None
    got = [r["v"] for r in cleaning.impute_mean(frame, ["v"]).orderBy("id").collect()]
    assert all((g is None and mean is None) or abs(g - (mean if v is None else v)) < 1e-9 for g, v in zip(got, values))


@relaxed
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 400)), min_size=1, max_size=80))
def test_histogram_loses_nothing(spark, pairs):
    frame = spark.createDataFrame([(g, float(v)) for g, v in pairs], "g string, v double")
    table = histograms.histogram(frame, "v", ["g"], bins=7)
    counts = {r[0]: r[1] for r in table.groupBy("g").agg(F.sum("n")).collect()}
    assert counts == {g: sum(h == g for h, _ in pairs) for g in {g for g, _ in pairs}}


@relaxed
@given(st.lists(st.sampled_from([0, 1, None]), min_size=1, max_size=80), st.sampled_from([0.0, 0.2, 0.5, 1.0]))
def test_split_shares(spark, labels, fraction):
    frame = spark.createDataFrame(list(enumerate(labels)), "id int, label int")
    split = sampling.stratified_split(frame, "label", "id", fraction).collect()
    assert sorted(r["id"] for r in split) == list(range(len(labels)))
    for label in set(labels):
        chosen = sum(r["is_test"] for r in split if r["label"] == label)
        assert chosen == int(labels.count(label) * fraction + 0.5)
