"""Merges, numbers and cascading deletions against plain dictionaries."""

import random

from pyspark.sql import functions as F

from tessera.sources import merge


def test_merge_by_rules(spark):
    old = spark.createDataFrame([(1, 10, "a", "x", 5, 1), (2, 11, "b", "y", None, 2), (None, 12, "c", "z", 1, 3)], "k int, id long, name string, note string, best int, n int")
    new = spark.createDataFrame([(1, "A", "", 3, 4, 0), (1, "old", "o", 9, 9, -1), (3, "C", None, 7, 1, 0), (None, "N", "nn", 2, 1, 0), (4, "D", "", 1, 1, 0)], "k int, name string, note string, best int, n int, at int")
    got = merge.merge(old, new, "k", "at", {"note": "filled", "best": "max", "n": "sum"}, "id")
    assert got.columns == old.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, 10, "A", "x", 5, 5), (2, 11, "b", "y", None, 2), (None, 12, "N", "nn", 2, 4), (3, 13, "C", None, 7, 1), (4, 14, "D", "", 1, 1)], key=repr
    )
    assert merge.merge(old, new.limit(0), "k").count() == 3 and merge.merge(old.limit(0), new, "k", "at", number="id").agg(F.max("id"), F.count("*")).first() == (4, 4)


def test_numbers_go_on_in_order(spark):
    r = random.Random(3)
    keys = [r.randrange(50) for _ in range(300)]
    got = merge.numbered(spark.createDataFrame([(k,) for k in keys], "k int").repartition(5), "k", "n", 7).orderBy("n").collect()
    assert [x.n for x in got] == list(range(7, 307)) and [x.k for x in got] == sorted(keys)


def test_deletions_cascade(spark):
    docs = spark.createDataFrame([(1, 5), (2, 5), (3, 50), (None, 1)], "doc_id int, updated int")
    parts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "doc_id int, part string")
    gone = spark.createDataFrame([(1, 10), (1, 3), (3, 20), (None, 99), (9, 1)], "doc_id int, at int")
    left = merge.without({"docs": docs, "parts": parts}, gone, "doc_id", "at", "updated")
    assert {r.doc_id for r in left["docs"].collect()} == {2, 3, None} and {r.part for r in left["parts"].collect()} == {"c", "e"}
