from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kartotek.operators.shred import restore, shred

SCHEMA = (
    "id long, `a.b` string, s struct<x:int,t:struct<y:string>>, l array<int>, "
    "h array<struct<n:string,in:array<struct<v:double,w:array<string>>>>>, m map<string,array<long>>, g array<array<int>>"
)
DATA = [
    (1, "p", (1, ("q",)), [3, None, 1], [("n1", [(1.0, ["a", None]), (2.0, [])]), None, (None, None)], {"k": [1, 2], "z": None}, [[1], [], None]),
    (2, None, None, None, None, None, None),
    (3, "", (None, None), [], [], {}, []),
    (None, "nk", (None, (None,)), [None], [("b", [None, (None, None)])], {"": []}, [[None, 2]]),
    (4, "last", (4, None), list(range(300)), [(str(i), [(float(i), ["x"] * (i % 3))]) for i in range(40)], {"a": [7]}, None),
]


def plain(frame):
    return sorted((r.asDict(recursive=True) for r in frame.collect()), key=lambda r: (r["id"] is not None, r["id"] or 0))


def test_tables(spark):
    tables = shred(spark.createDataFrame(DATA, SCHEMA), ["id"])
    assert list(tables) == ["", "l[]", "h[]", "h[].in[]", "h[].in[].w[]", "m[]", "m[].value[]", "g[]", "g[][]"]
    assert tables[""].columns == ["id", r"a\.b", "s?", "s.x", "s.t?", "s.t.y", "l#", "h#", "m#", "g#"]
    assert tables["h[].in[]"].columns == ["^id", "@1", "@2", "?", "v", "w#"]
    got = [tuple(r) for r in tables["h[].in[]"].filter("`^id` = 1").orderBy("@1", "@2").collect()]
    assert got == [(1, 0, 0, True, 1.0, 2), (1, 0, 1, True, 2.0, 0)]
    lengths = {r["id"]: (r["l#"], r["h#"]) for r in tables[""].collect()}
    assert lengths == {1: (3, 3), 2: (None, None), 3: (0, 0), None: (1, 1), 4: (300, 40)}
    assert tables["m[]"].filter("`^id` = 1").orderBy("key").select("key", "value#").collect() == [("k", 2), ("z", None)]


def test_round_trip_through_files(spark, tmp_path):
    frame = spark.createDataFrame(DATA, SCHEMA)
    stored = {}
    for i, (name, table) in enumerate(shred(frame, ["id"]).items()):
        table.repartition(3, F.rand(1)).write.parquet(str(tmp_path / str(i)))
        stored[name] = spark.read.parquet(str(tmp_path / str(i)))
    back = restore(stored, frame.schema, ["id"])
    assert back.columns == frame.columns
    assert [f.dataType.simpleString() for f in back.schema] == [f.dataType.simpleString() for f in frame.schema]
    assert plain(back) == plain(frame)
    empty = frame.limit(0)
    assert restore(shred(empty, ["id"]), frame.schema, ["id"]).count() == 0


def test_only_own_leaves_are_read(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.createDataFrame(DATA, SCHEMA).write.parquet(path)
    table = shred(spark.read.parquet(path), ["id"])["l[]"]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,l:array<int>>" in plan and "Exchange" not in plan


def test_clashing_names(spark):
    with pytest.raises(ValueError, match="x.y"):
        shred(spark.createDataFrame([(1, (2,))], "`x.y` int, x struct<y:int>"), ["x.y"])
    kind = (
        "id long, x struct<y:int>, `x.y` int, `l[]` array<struct<id:int,`@1`:int,`^id`:int,value:struct<value:int>>>, "
        "m map<string,struct<value:array<int>>>, `__list0` array<int>, `@list0` int"
    )
    frame = spark.createDataFrame([(1, (2,), 3, [(9, 8, 7, (6,)), (5, 4, 3, None)], {"k": ([1],)}, [5], 6), (2, None, None, [], {}, None, None)], kind)
    assert plain(restore(shred(frame, ["id"]), frame.schema, ["id"])) == plain(frame)


words = st.none() | st.sampled_from(["", "u", "vv"])
inner = st.none() | st.tuples(words, st.none() | st.lists(st.none() | st.integers(-3, 3), max_size=3))
rows = st.lists(st.tuples(st.none() | st.lists(inner, max_size=3), st.none() | st.tuples(words)), max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows)
def test_any_table_comes_back(spark, data):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, l array<struct<a:string,b:array<int>>>, s struct<c:string>")
    assert plain(restore(shred(frame, ["id"]), frame.schema, ["id"])) == plain(frame)
