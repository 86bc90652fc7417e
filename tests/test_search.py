"""BM25 in small blocks against loops, and the recall of the inverted file."""

import math
import random
from collections import Counter

import pytest

from tessera.operators import dispatch, retrieval
from tessera.plans import search


@pytest.mark.parametrize(("block", "sent"), [(1024, 1_000_000), (7, 1_000_000), (7, 0)])
def test_bm25_equals_loops(spark, block, sent):
    r = random.Random(block)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choice(words[: r.randint(1, 30)]) for _ in range(r.randint(0, 20)))) for i in range(90)] + [(90, None), (91, "w1 w1 w2")]
    asked = [(i, " ".join(r.choice([*words, "none"]) for _ in range(r.randint(0, 6)))) for i in range(25)]
    held = {i: Counter((t or "").split()) for i, t in docs}
    df, n, avgdl = Counter(w for c in held.values() for w in c), len(docs), sum(sum(c.values()) for c in held.values()) / len(docs)
    want = []
    for q, text in asked:
        scores = []
        for i, c in held.items():
            s = sum(k * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for w, k in Counter(text.split()).items() if c[w])
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        want += [(q, i, rank) for rank, (_, i) in enumerate(sorted(scores)[:8], 1)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")
    got = retrieval.bm25_search(left, right, 8, block=block, most_sent=sent)
    assert sorted((x.query_id, x.doc_id, x["rank"]) for x in got.collect()) == sorted(want)
    assert retrieval.bm25_search(left.limit(0), right, 8).count() == 0 and retrieval.bm25_search(left, right.limit(0), 8).count() == 0


def test_recall_of_the_inverted_file(spark):
    some = search.ivf_recall(spark, "/root/testdata/sf0.1", 32, 16)
    assert 0.85 <= some < 1.0 and search.ivf_recall(spark, "/root/testdata/sf0.1", 32, 32) == 1.0


def test_lists_are_searched_in_pieces(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=(240, 6)).round(2), -np.ones((60, 6))))  # one list holds many copies; scores below zero count
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    asked = v.filter("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding")
    found = dispatch.ivf_search(v, asked, 7, lists=4, probes=4, block=16, piece=20).collect()
    s = (x @ x.T).round(6)
    want = {(i, n + 1): (int(j), s[i, j]) for i in range(0, 300, 3) for n, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:7])}
    assert {(h.query_id, h.rank): (h.vec_id, h.score) for h in found} == want
    assert {h.query_id for h in dispatch.ivf_search(v, asked, 300, lists=2, probes=2, block=7).filter("rank = 300").collect()} == set(range(0, 300, 3))


def test_words_are_read_in_pieces():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"k": list(range(9)), "w": [["a", "b", "c"]] * 5 + [None, [], ["a"] * 20, ["b"]]})
    pieces = list(retrieval._pieces(rows, 1, 7))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([rows])) and [p.num_rows for p in pieces] == [2, 2, 3, 1, 1]
    assert list(retrieval._pieces(rows.slice(0, 0), 1, 7)) == []


def test_index_of_terms_shuffles_no_postings(spark):
    rows = [(1, "a b b"), (1, "b c a"), (1, "x"), (2, None), (None, "a d d"), (None, "e a d"), (3, "")]
    post, terms = retrieval.bm25_index(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter(r.term for r in post.collect())
    assert {r.term: r.df for r in terms.collect()} == want and want["a"] == 2
    once = retrieval.bm25_index(spark.createDataFrame([(1, "a b b"), (2, "b c a")], "doc_id long, text string"))[1]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and plan.count("lower(") == 1 and {r.term: r.df for r in once.collect()} == {"a": 2, "b": 2, "c": 1}


def test_strategies_share_a_pass(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} word", "ab"[i % 2], f"doc{i % 4}") for i in range(60)], "chunk_id long, content string, lang string, doc_name string")
    vectors = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(60)], "chunk_id long, embedding array<double>")
    cells = spark.createDataFrame([], "table_id string, chunk_id long, row_index int, col_name string, value string")
    up, side = (1.0, 0.5), (0.0, 1.0)
    asked = [
        dispatch.Request("w1 w2", "bm25", 9, {"lang": "a", "doc_name": "none"}), dispatch.Request("w1 w2", "hybrid", 12, {"doc_name": "doc1"}, up, bm25_k=30, vector_k=25), dispatch.Request("w4", "bm25", 30),
        dispatch.Request("", "dense", 7, {"lang": "b"}, up), dispatch.Request("", "dense", 5, vector=side), dispatch.Request("", "bm25", 5), dispatch.Request("word", "exact", 8, {"lang": "b"}),
    ]
    alone = [sorted(map(tuple, dispatch.Engine(chunks, vectors, cells).search(r).select("chunk_id", "score", "rank").collect())) for r in asked]
    calls = Counter()
    for name in ("bm25_search", "knn"):
        monkeypatch.setattr(retrieval, name, lambda *a, _name=name, _real=getattr(retrieval, name), **k: calls.update([_name]) or _real(*a, **k))
    found = [sorted(map(tuple, hits.select("chunk_id", "score", "rank").collect())) for hits in dispatch.Engine(chunks, vectors, cells).search_all(asked)]
    assert found == alone and all(len(x) for x, r in zip(found, asked, strict=True) if r.query or r.vector)
    assert calls == {"bm25_search": 2, "knn": 1}  # the empty text finds nothing and is asked by itself


def test_filters_shuffle_no_ids_of_all_chunks(spark):
    chunks = spark.range(50_000).selectExpr("id AS chunk_id", "concat('w', id % 7, ' w', id) AS content", "IF(id % 2 = 0, 'a', 'b') AS lang")
    hits = dispatch.Engine(chunks).search(dispatch.Request("w3", "bm25", 5, {"lang": "a"}))
    assert [x.chunk_id % 2 for x in hits.collect()] == [0] * hits.count() != []
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi, (chunk_id") < plan.rindex("Join LeftSemi") and "strategy=broadcast" in plan, plan
