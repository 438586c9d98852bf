from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartotek.operators import term_hash, words


def test_a_million_terms_have_a_slot_each():
    generator = np.random.default_rng(1)
    keys = np.unique(generator.integers(0, 2**64, 1_000_000, dtype=np.uint64))
    numbers = generator.permutation(len(keys))
    shard = term_hash.Shard(keys, numbers)
    assert np.array_equal(shard.find(keys), numbers)
    assert sorted(shard._slots(keys).tolist()) == list(range(len(keys)))
    others = generator.integers(0, 2**64, 100_000, dtype=np.uint64)
    assert (shard.find(others[~np.isin(others, keys)]) == -1).all()
    bits = sum(w.nbytes + r.nbytes for w, r in zip(shard.words, shard.ranks)) * 8
    assert bits < 8 * len(keys)


def test_equal_hashes_are_an_error():
    with pytest.raises(ValueError, match="same 64-bit hash"):
        term_hash.Shard(np.array([5, 5, 6], np.uint64), np.arange(3))


def test_hashes_are_those_of_the_engine(spark):
    terms = ["", "a", "Ünï", "x" * 1000, "\u0000", "😀"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t")).collect()]
    assert term_hash.hashes([t.encode() for t in terms]).view(np.int64).tolist() == got


def tables(spark, n):
    dictionary = spark.range(n).select(F.concat(F.lit("term "), "id").alias("term"), F.col("id").alias("term_index"))
    rows = [(1, ["term 3", "term 3", "unknown", None]), (2, None), (3, []), (1, ["term 0", f"term {n - 1}"]), (4, ["unknown"])]
    return dictionary, spark.createDataFrame(rows, "key long, tokens array<string>")


@pytest.mark.parametrize("shard_terms", [1 << 20, 1_500])
def test_shards_find_what_one_finds(spark, shard_terms):
    dictionary, _ = tables(spark, 10_000)
    found = term_hash.term_hash(dictionary, shard_terms)
    assert len(found.shards) == -(-10_000 // shard_terms)
    terms = [f"term {i}".encode() for i in range(10_000)]
    assert found.find([*terms, b"", b"term", b"term 10000"]).tolist() == [*range(10_000), -1, -1, -1]
    assert term_hash.term_hash(dictionary, 1_000) is None


@pytest.mark.parametrize("binary", [True, False])
def test_vectors_are_those_of_the_join(spark, binary):
    dictionary, frame = tables(spark, 50)
    plain = words.token_vectors(frame, ["key"], "tokens", dictionary, "v", binary)
    joined = words._joined_vectors(frame, ["key"], "tokens", dictionary, "v", binary)
    order = lambda rows: sorted((r["key"], r["v"].size, r["v"].indices.tolist(), r["v"].values.tolist()) for r in rows.collect())
    assert order(plain) == order(joined) and len(order(plain)) == 5
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_bags_are_those_of_the_join(spark):
    dictionary, frame = tables(spark, 50)
    some = frame.filter("key > 1").unionByName(frame.filter("key = 1").limit(1))
    plain = sorted(map(tuple, words.bag_of_words(some, "key", "tokens", dictionary).collect()))
    assert plain == sorted(map(tuple, words._joined_bag(some, "key", "tokens", dictionary, "drop").collect()))
    with pytest.raises(Exception, match="term not in the dictionary: unknown"):
        words.bag_of_words(some, "key", "tokens", dictionary, "error").collect()


def test_numbers_must_be_consecutive(spark):
    frame = spark.createDataFrame([("a", 0), ("b", 2)], "term string, term_index long")
    with pytest.raises(ValueError, match="2 terms numbered 0 to 2"):
        term_hash.term_hash(frame)
    tokens = spark.createDataFrame([(1, ["b", "b", "a"])], "key long, tokens array<string>")
    assert sorted(map(tuple, words.bag_of_words(tokens, "key", "tokens", frame).collect())) == [(1, 0, 1), (1, 2, 2)]
    with_null = spark.createDataFrame([("a", 0), (None, 1)], "term string, term_index long")
    assert term_hash.term_hash(with_null).find([b"a", b""]).tolist() == [0, -1]
    assert term_hash.term_hash(frame.limit(0)).find([b"a"]).tolist() == [-1]
