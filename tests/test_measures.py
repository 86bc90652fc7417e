"""Latency statistics against sorted lists."""

import random

from tessera.operators import measures


def test_latency_places_equal_sorted_lists(spark):
    r = random.Random(2)
    of = {"one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 500, "many": [float(r.randrange(40)) for _ in range(2000)], "wide": [r.random() for _ in range(3001)], None: [1.0, 5.0, 9.0]}
    rows = [(k, v) for k, vs in of.items() for v in vs] + [("two", None), ("void", None)]
    got = {x.k: (x.least, x.most, x.p50, x.p95) for x in measures.latency_stats(spark.createDataFrame(rows, "k string, v double").repartition(5), "v", "k").collect()}
    assert got == {k: (min(v), max(v), sorted(v)[len(v) // 2], sorted(v)[int(0.95 * len(v))]) for k, v in of.items()}
