from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from kartotek.sources import json_types as J

GOOD = [
    '{"a":1,"b c":{"x":1.5}}',
    '{"a":"q","d":[1,2.5,null],"e":{}}',
    '{"a":null,"f":[],"g":99999999999999999999999}',
    '{"OBJECT<":1,"t`k":true,"b c":{"y":[{"p":1},{"p":"2","q":[]}]}}',
    '{"n":1e3,"d":null,"z":null}',
    '{"n":7,"d":[[1]]}',
]
BAD = ['{bad', "5", "[1]", "null", '{"a":1,"a":2}', '{"a":1} x', '{"a":1', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{}', '{"a":1}},"b":{']


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([*lines, "", "  "]))
    return str(folder / name)


def as_dict(schema):
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def test_schema_records_and_bad_lines(spark, tmp_path):
    write(tmp_path / "in", "a.json", GOOD[:3] + BAD[:4])
    write(tmp_path / "in", "b.json", BAD[4:] + GOOD[3:])
    lines = J.numbered_lines(spark, str(tmp_path / "in"))
    schema = J.found_schema(lines)
    assert as_dict(schema) == {
        "OBJECT<": "bigint", "a": "string", "b c": "struct<x:double,y:array<struct<p:string,q:array<void>>>>",
        "d": "array<string>", "e": "struct<>", "f": "array<void>", "g": "double", "n": "double", "t`k": "boolean", "z": "void",
    }
    told = {(r["file"].rsplit("/", 1)[1], r["line"]) for r in J.bad_lines(lines).collect()}
    assert told == {("a.json", x) for x in BAD[:4]} | {("b.json", x) for x in BAD[4:]}
    rows = J.records(lines, schema).collect()
    assert len(rows) == len(GOOD)
    assert sorted((r["a"] or "", r["n"] or 0.0) for r in rows) == [("", 0.0), ("", 0.0), ("", 7.0), ("", 1000.0), ("1", 0.0), ("q", 0.0)]
    assert {tuple(r["d"]) for r in rows if r["d"]} == {("1", "2.5", None), ("[1]",)}
    J.records(lines, schema).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(GOOD)


def test_batches_in_any_order(spark, tmp_path):
    paths = [write(tmp_path / "in", f"{i}.json", GOOD[2 * i : 2 * i + 2]) for i in range(3)]
    whole = J.found_schema(J.numbered_lines(spark, paths))
    for order in itertools.permutations(paths):
        known = None
        for path in order:
            known = J.found_schema(J.numbered_lines(spark, path), known)
            J.save_schema(spark, known, str(tmp_path / "schema"))
            known = J.load_schema(spark, str(tmp_path / "schema"))
        assert known == whole


def test_no_records(spark, tmp_path):
    lines = J.numbered_lines(spark, write(tmp_path / "in", "a.json", BAD))
    assert J.found_schema(lines) == T.StructType([])
    known = T.StructType([T.StructField("a", T.LongType())])
    assert J.found_schema(lines, known) == known
    assert J.records(lines, known).count() == 0 and J.bad_lines(lines).count() == len(BAD)


def test_schema_table(spark):
    kind = T.StructType.fromDDL("a bigint, b array<struct<p:string,q:array<double>>>")
    got = [tuple(r) for r in J.schema_table(spark, kind).collect()]
    assert got == [
        ("a", "bigint"), ("b", "array"), ("b[]", "struct"), ("b[].p", "string"), ("b[].q", "array"), ("b[].q[]", "double"),
    ]


leaves = st.sampled_from([T.NullType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()])
kinds = st.recursive(
    leaves,
    lambda inner: inner.map(T.ArrayType)
    | st.dictionaries(st.sampled_from("abc"), inner).map(lambda d: T.StructType([T.StructField(n, d[n]) for n in sorted(d)])),
    max_leaves=6,
)


@settings(max_examples=300, deadline=None)
@given(kinds, kinds, kinds)
def test_the_join_is_a_lattice(a, b, c):
    join = J.joined_types
    assert join(a, a) == a
    assert join(a, b) == join(b, a)
    assert join(join(a, b), c) == join(a, join(b, c))
    assert join(a, join(a, b)) == join(a, b)
