from __future__ import annotations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kartotek import sizing
from kartotek.functions.text import words
from kartotek.operators import indexing, onehot
from kartotek.operators import words as bags


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture(params=["small", "large"])
def size(request, monkeypatch):
    """Both ways of every lookup: broadcast when small, salted join when not."""
    if request.param == "large":
        monkeypatch.setattr(sizing, "SMALL_ROWS", 1)
        monkeypatch.setattr(sizing, "SMALL_NESTED_ROWS", 1)
    return request.param


def test_settle_limits(spark):
    frame = spark.range(10).withColumn("v", F.array(F.lit(1.5)))
    assert rows(sizing.settle(frame, 10)) == rows(frame)
    assert sizing.settle(frame, 9) is None
    assert sizing.settle(frame, 10, max_bytes=10) is None
    assert rows(sizing.settle(frame.filter("id < 0"))) == []
    stamps = spark.range(1).withColumn("t", F.timestamp_seconds("id"))
    assert rows(sizing.settle(stamps)) == rows(stamps)
    wide = spark.createDataFrame([(i, Vectors.dense([1.0] * 1000)) for i in range(20)], ["k", "v"])
    assert sizing.settle(wide, max_bytes=100_000) is None and sizing.settle(wide, max_bytes=200_000) is not None


def test_bytes_of_values(spark):
    row = spark.createDataFrame(
        [("abc", [1, 2], ["ab", None], {"k": "vvv"}, (1, "xy"), None)],
        "s string, n array<int>, t array<string>, m map<string,string>, r struct<a:int,b:string>, e string",
    )
    got = [row.select(sizing.value_bytes(F.col(f.name), f.dataType)).first()[0] for f in row.schema.fields]
    assert got == [11, 24, 8 + 10 + 8, 17 + 19, 8 + 8 + 10, 8]


def test_equal_rows_spread_over_all_salts(spark, monkeypatch):
    monkeypatch.setattr(sizing, "SMALL_ROWS", 1)
    facts = spark.range(2_000).select(F.lit(7).alias("a.k")).repartition(64)
    lookup = spark.createDataFrame([(7, 1), (8, 2)], "`a.k` int, v int")
    joined = sizing.lookup_join(facts, lookup, ["a.k"])
    assert joined.columns == ["a.k", "v"] and joined.agg(F.sum("v")).first()[0] == 2_000
    salts = facts.select(F.pmod(F.spark_partition_id() + F.xxhash64("`a.k`"), F.lit(sizing.SALTS)))
    assert salts.distinct().count() == sizing.SALTS


def test_large_vector_lookups_are_not_broadcast(spark, monkeypatch):
    lookup = spark.createDataFrame([(i, Vectors.dense([1.0] * 500)) for i in range(50)], ["k", "v"])
    facts = spark.range(50).select(F.col("id").alias("k"))
    monkeypatch.setattr(sizing.settle, "__defaults__", (None, 100_000))
    plan = sizing.lookup_join(facts, lookup, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "broadcast" not in plan


def test_clean_up(spark):
    mark = sizing.made_so_far()
    frame = sizing.pinned(spark.range(3))
    assert frame.count() == 3 and sizing.made_so_far() == mark + 1
    sizing.clean_up(spark, mark)
    assert sizing.made_so_far() == mark
    with pytest.raises(Exception):
        spark.read.parquet(frame.inputFiles()[0]).count()


def test_settled_vectors_and_maps(spark, size):
    rows_in = spark.createDataFrame([(1, Vectors.dense([1.0]))], ["k", "v"])
    facts = spark.range(3).select(F.col("id").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    assert sorted(r[2] is None for r in rows(sizing.lookup_join(facts, rows_in, ["k"]))) == [False, True, True]


def test_lookup_join(spark, size):
    facts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "z")], "id int, k string")
    lookup = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, v int")
    got = sorted(rows(sizing.lookup_join(facts, lookup, ["k"])))
    assert got == [(1, "a", 10), (2, "a", 10), (3, "b", 20), (4, None, 30), (5, "z", None)]
    assert len(rows(sizing.lookup_join(facts, lookup, ["k"], "inner"))) == 4
    assert len(rows(sizing.lookup_join(facts, lookup.filter("k = 'a'"), ["k"], "left_semi"))) == 2


def test_salts_spread_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sizing, "SMALL_ROWS", 1)
    facts = spark.range(10_000).withColumn("k", F.lit(7))
    lookup = spark.createDataFrame([(7, 1), (8, 2)], "k int, v int")
    joined = sizing.lookup_join(facts, lookup, ["k"])
    assert joined.agg(F.sum("v")).first()[0] == 10_000
    assert "__salt" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_copies_follow_the_count_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(sizing, "SMALL_ROWS", 2)
    monkeypatch.setattr(sizing, "HOT_ROWS", 1_000)
    facts = spark.range(9_000).select(
        F.when(F.col("id") < 6_500, F.lit(7)).when(F.col("id") < 8_600, F.lit(None)).otherwise(F.col("id")).cast("int").alias("a.k"),
        F.col("id").alias("v"),
    ).repartition(16)
    lookup = spark.createDataFrame([(7, 1), (8, 2), (None, 3), (8_700, 4)], "`a.k` int, w int")
    assert sorted(rows(sizing.hot_keys(facts, ["a.k"])), key=str) == [(7, 7), (None, 3)]
    joined = sizing.lookup_join(facts, lookup, ["a.k"])
    assert joined.columns == ["a.k", "v", "w"] and joined.count() == 9_000
    assert joined.agg(F.sum("w")).first()[0] == 6_500 + 3 * 2_100 + 4
    assert sizing.lookup_join(facts, lookup, ["a.k"], "inner").count() == 8_601
    assert sizing.lookup_join(facts, lookup, ["a.k"], "left_semi").columns == ["a.k", "v"]
    monkeypatch.setattr(sizing, "SMALL_ROWS", 1)
    assert sizing.lookup_join(facts, lookup, ["a.k"]).agg(F.sum("w")).first()[0] == 6_500 + 3 * 2_100 + 4


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sizing.shared_folder(Session())


def test_row_index(spark):
    frame = spark.range(5000).select((F.col("id") % 2).alias("hot"), F.col("id"), F.lit("x").alias("a:b"))
    got = indexing.row_index(frame.repartition(7), ["hot", F.desc("id")])
    assert got.columns == ["Index", "hot", "id", "a:b"]
    expected = sorted(rows(frame), key=lambda r: (r[0], -r[1]))
    assert [r[1:] for r in sorted(rows(got))] == expected
    assert sorted(r[0] for r in got.select("Index").collect()) == list(range(5000))
    assert rows(indexing.row_index(frame.filter("id < 0"), ["id"])) == []
    unsorted = indexing.row_index(frame.coalesce(1))
    assert [r[0] for r in sorted(rows(unsorted))] == [r[0] for r in sorted(rows(unsorted), key=lambda r: r[2])]
    assert unsorted.select("Index").distinct().count() == 5000


def test_term_dictionary(spark):
    frame = spark.createDataFrame([(["hej", "med"],), (["dig", "hej", None],), ([],)], "t array<string>")
    got = sorted((r["term_index"], r["term"]) for r in indexing.term_dictionary(frame, "t").collect())
    assert got == [(0, "dig"), (1, "hej"), (2, "med")]


def test_string_index(spark, size):
    data = [("b", "x"), ("b", "y"), ("a", "y"), ("a", "x"), ("c", "y")]
    frame = spark.createDataFrame(data, "s string, t string")
    got = set(rows(indexing.string_index(frame, {"s": "si", "t": "ti"})))
    assert got == {("b", "x", 1, 1), ("b", "y", 1, 0), ("a", "y", 0, 0), ("a", "x", 0, 1), ("c", "y", 2, 0)}
    ranks = indexing.value_ranks(frame, ["s"])
    other = spark.createDataFrame([("z",), ("c",), (None,)], "s string")
    assert set(rows(indexing.string_index(other, {"s": "si"}, ranks, "null"))) == {("z", None), ("c", 2.0), (None, None)}
    with pytest.raises(Exception, match="without an index"):
        indexing.string_index(other.filter("s = 'z'"), {"s": "si"}, ranks).collect()


def test_pivot_onehot(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b.c")], "Index int, k string")
    got = onehot.pivot_onehot(frame, "k")
    assert got.columns == ["Index", "k:a", "k:b.c", "k:null"]
    assert sorted(rows(got)) == [(1, 2, 0, 1), (2, 0, 1, 0)]


def test_onehot_all(spark, size):
    frame = spark.createDataFrame([(1, "a", 5, "x"), (2, None, 6, "y")], "Index int, k string, n int, t string")
    values = {"k": ["a", None], "t": ["x", "y"]}
    expected = [(1, 5, 1, 0, 1, 0), (2, 6, 0, 1, 0, 1)]
    for unique in (True, False):
        got = onehot.onehot_all(frame, values=values, unique_index=unique)
        assert got.columns == ["Index", "n", "k:a", "k:null", "t:x", "t:y"]
        assert sorted(rows(got)) == expected
    assert rows(onehot.onehot_all(frame.select("Index", "n"))) == [(1, 5), (2, 6)]


def test_onehot_values(spark):
    frame = spark.createDataFrame([(1, "b", "x"), (2, None, "x"), (3, "a", "y")], "Index int, k string, t string")
    assert onehot.column_values(frame, ["k", "t"]) == {"k": ["a", "b", None], "t": ["x", "y"]}
    with pytest.raises(ValueError, match="onehot_sparse"):
        onehot.column_values(frame, ["k", "t"], max_width=4)


def test_onehot_sparse(spark, size):
    frame = spark.createDataFrame([(1, "b", "x"), (2, None, "x"), (3, "a", "y")], "Index int, k string, t string")
    vectors, dictionary = onehot.onehot_sparse(frame)
    terms = [r["term"] for r in dictionary.orderBy("term_index").collect()]
    assert terms == ["k:a", "k:b", "k:null", "t:x", "t:y"]
    got = {r["Index"]: list(r["onehot"].toArray()) for r in vectors.collect()}
    assert got == {1: [0, 1, 0, 1, 0], 2: [0, 0, 1, 1, 0], 3: [1, 0, 0, 0, 1]}


@pytest.fixture
def turns(spark):
    frame = spark.createDataFrame([(1, "hej med dig hej hej"), (2, "ukendt dig"), (3, "")], "id int, t string")
    return frame.select("id", words(F.col("t")).alias("tokens"))


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame([("hej", 0), ("med", 1), ("dig", 2)], "term string, term_index long")


@pytest.mark.parametrize("terms", [1, 2_000, 2_001])
def test_vectors_of_odd_rows_at_any_vocabulary(spark, terms):
    """Repeated ids, null and empty arrays and unknown tokens answer the same at every number of terms."""
    dictionary = spark.range(terms).select(F.concat(F.lit("t"), F.col("id")).alias("term"), F.col("id").alias("term_index"))
    last = f"t{terms - 1}"
    data = [(1, [last, "x", last]), (1, ["t0"]), (2, None), (2, []), (None, [None, "t0"])]
    frame = spark.createDataFrame(data, "id int, tokens array<string>")
    got = bags.bag_of_words_vectors(frame, "id", "tokens", dictionary).collect()
    held = sorted((r["id"] or 0, r["features"].size, tuple(r["features"].indices), tuple(r["features"].values)) for r in got)
    assert held == sorted(
        [(1, terms, (terms - 1,), (2.0,)), (1, terms, (0,), (1.0,)), (2, terms, (), ()), (2, terms, (), ()), (0, terms, (0,), (1.0,))]
    )
    with pytest.raises(ValueError, match="terms numbered"):
        bags.bag_of_words_vectors(frame, "id", "tokens", dictionary.withColumn("term_index", F.col("term_index") * 2 + 1))


def test_onehot_sparse_of_a_repeated_index(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None)], "Index int, k string")
    vectors, _ = onehot.onehot_sparse(frame)
    got = sorted((r["Index"], tuple(r["onehot"].toArray())) for r in vectors.collect())
    assert got == [(1, (0, 1, 0)), (1, (1, 0, 0)), (1, (1, 0, 0)), (2, (0, 0, 1))]


def test_bag_of_words(turns, dictionary, size):
    got = sorted(rows(bags.bag_of_words(turns, "id", "tokens", dictionary)))
    assert got == [(1, 0, 3), (1, 1, 1), (1, 2, 1), (2, 2, 1)]
    with pytest.raises(Exception, match="not in the dictionary"):
        bags.bag_of_words(turns, "id", "tokens", dictionary, unknown="error").collect()


def test_token_counts(spark):
    data = [("x", ["b", "a", None, "b"]), ("y", []), ("z", None), ("w", ["a"])]
    frame = spark.createDataFrame(data, "`the id` string, t array<string>")
    got = bags.token_counts(frame.coalesce(1), "the id", "t")
    assert got.columns == ["the id", "term", "n"]
    assert sorted(rows(got)) == [("w", "a", 1), ("x", "a", 1), ("x", "b", 2)]
    assert rows(bags.token_counts(frame.filter("t is null"), "the id", "t")) == []
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("coalesce", "")


def test_bag_of_words_vectors(turns, dictionary, size):
    got = {r["id"]: r["features"] for r in bags.bag_of_words_vectors(turns, "id", "tokens", dictionary).collect()}
    assert got[1] == Vectors.sparse(3, {0: 3.0, 1: 1.0, 2: 1.0})
    assert list(got[2].toArray()) == [0, 0, 1] and list(got[3].toArray()) == [0, 0, 0]


def test_word_count(spark):
    frame = spark.createDataFrame([("Hej  hej\tdig",), (None,), (" ",)], "t string")
    assert sorted(rows(bags.word_count(frame, "t"))) == [("dig", 1), ("hej", 2)]
