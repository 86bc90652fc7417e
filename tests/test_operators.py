"""Order, tie and null rules on small tables with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import parse_date, tokens
from tessera.operators import answers, evidence, facts, filters, graph, measures, names, retrieval, states
from tessera.plans import routing
from tessera.sources import tables
from tessera.streaming import events


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tokens_delete_punctuation_without_breaking_words(spark):
    df = spark.createDataFrame([("A,b c_d  E!",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["ab", "cd", "e"], [], None]


def test_parse_date_layouts(spark):
    df = spark.createDataFrame([("2024-03-05",), ("2024/03/05",), ("20240305",), ("2024年03月05日",), ("x",)], "t string")
    assert [str(r[0]) for r in df.select(parse_date(F.col("t"))).collect()] == ["2024-03-05"] * 4 + ["None"]


def test_rrf_prefers_rows_of_both_channels(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    assert rows(retrieval.rrf([a, b], 3), "rank", "doc_id") == [(1, 11), (2, 10), (3, 12)]


def test_bm25_ties_go_to_the_smaller_key(spark):
    docs = spark.createDataFrame([(2, "red cat"), (1, "red cat"), (3, "blue dog"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red")], "query_id long, query string")
    assert rows(retrieval.bm25_search(docs, q, 5), "rank", "doc_id") == [(1, 1), (2, 2)]


def test_pack_context_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, "a" * 5), (1, 2, "b" * 7), (1, 3, "c")], "query_id long, rank int, content string")
    assert rows(retrieval.pack_context(hits, 6, 10), "rank") == [(1,)]


def test_dedup_rules(spark):
    h = spark.createDataFrame([(1, "a", "same text", 0.5), (2, "a", "other one", 0.9), (3, "", " same text ", 0.9), (4, None, "x", 0.1)], "idx int, chunk_id string, content string, score double")
    assert rows(evidence.dedup_ids(h), "idx") == [(1,), (3,), (4,)]
    assert rows(evidence.dedup_contents(h), "idx") == [(2,), (3,), (4,)]


def test_contained_contents_go_but_equal_ones_stay(spark):
    h = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "quick brown fox"), (3, "quick brown fox"), (4, "short"), (5, "unrelated text here")], "idx int, content string")
    assert rows(evidence.dedup_contained(h), "idx") == [(1,), (4,), (5,)]


def test_parents_keep_the_first_best_hit(spark):
    h = spark.createDataFrame([(1, 5, 100, 0.5), (2, 5, 101, 0.5), (3, None, 102, 0.2)], "idx int, parent_id long, chunk_id long, score double")
    assert rows(evidence.parents(h).withColumn("n_children", F.size("children")), "chunk_id", "n_children") == [(100, 2), (102, 1)]
    assert [r.chunk_id for r in evidence.by_score(evidence.parents(h)).collect()] == [100, 102]


def test_relax_takes_the_first_level_with_rows(spark):
    d = spark.createDataFrame([(1, "en"), (2, "fr")], "id int, lang string")
    assert rows(filters.relax(d, [{"lang": ("eq", "de")}, {"lang": ("eq", "fr")}, {}]), "id", "level") == [(2, 1)]


def test_filters_treat_bad_numbers_as_no_match(spark):
    d = spark.createDataFrame([("12",), ("x",), (None,)], "v string")
    assert rows(d.filter(filters.predicate("v", "gt", 5)), "v") == [("12",)]
    with pytest.raises(ValueError):
        filters.predicate("v", "like", 5)


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "query_id long, item long, rank int")
    rel = spark.createDataFrame([(1, 8), (2, 1)], "query_id long, item long")
    r = measures.ranking_metrics(hits, rel, (1, 3)).first()
    assert (r["mrr"], r["recall_1"], r["recall_3"], r["precision_3"], r["ndcg_3"]) == (0.25, 0.0, 0.5, 0.1667, 0.3155)


def test_plan_costs_by_hand(spark):
    s = spark.createDataFrame([("p", 1, 50, 0.95, 0.5, False), ("p", 1, 100, 0.85, 0.5, True), ("p", 2, 200, 0.8, 0.0, False)], "plan_id string, stage int, latency int, success double, gain double, rerank boolean")
    r = routing.plan_costs(s).first()
    assert (r["latency"], r["gain"], r["success"], r["cost"]) == (800, 0.75, 0.646, 1027.0)


def test_layers_and_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("a", "a"), ("b", "zz")], "node string, needs string")
    assert rows(graph.layers(edges, nodes), "node", "layer") == [("a", 0), ("b", 1), ("c", 2)]
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "node string, needs string")
    with pytest.raises(ValueError):
        graph.layers(ring, nodes)


def test_rate_window_and_session_edges(spark):
    e = spark.createDataFrame([(1, 1, 0), (2, 1, 60), (3, 1, 60 + 1800), (4, 1, 60 + 3601)], "event_id int, user_id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(events.sliding_counts(e), "event_id", "in_window") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert rows(events.sessions(e), "event_id", "session") == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_chunk_files_round_trip(spark, tmp_path):
    (tmp_path / "a_chunks.jsonl").write_text('{"chunk_id": "1", "chunk_type": "clause", "content": "x"}\n\nnot json\n{"chunk_id": "2", "chunk_type": "formula"}\n')
    assert [r for r in rows(tables.read_chunk_lines(spark, str(tmp_path)).filter("chunk_id IS NOT NULL"), "chunk_id")] == [("1",)]
    (tmp_path / "b_chunks.json").write_text('{"chunks": [{"chunk_id": "3", "content": "y"}, {"chunk_id": "4"}]}')
    assert rows(tables.read_chunk_documents(spark, str(tmp_path)), "chunk_id") == [("3",), ("4",)]


def test_streams_run_to_the_end(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, 0, 1.0), (1, 1, 5, 1.0), (2, 1, 9000, 2.0)], "event_id int, user_id int, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = events.stream_once(stream, "event_id").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM once").count() == 2
    q = events.stream_sessions(stream).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_events for r in spark.sql("SELECT * FROM sess").collect()) == [1, 2]


def test_a_move_that_is_not_legal_changes_nothing(spark):
    log = spark.createDataFrame([("a", 1, "NORMALIZED"), ("a", 2, "ROUTED"), ("a", 3, "CONTEXT_RESOLVED"), ("b", 1, "FAILED"), (None, 1, "NORMALIZED")], "k string, n int, state string")
    got = {(r.k, r.n): (r.after, r.accepted) for r in states.replay(log, "k", "n").collect()}
    assert got == {("a", 1): ("NORMALIZED", True), ("a", 2): ("NORMALIZED", False), ("a", 3): ("CONTEXT_RESOLVED", True), ("b", 1): ("RECEIVED", False)}


def test_cancelling_ends_on_cycles(spark):
    tasks = spark.createDataFrame([("a", "failed"), ("b", "pending"), ("c", "ready"), ("d", "completed"), ("e", "pending")], "node string, status string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("d", "a"), ("e", "d")], "node string, needs string")
    assert rows(graph.cancelled(tasks, edges), "node") == [("b",), ("c",)]
    assert rows(graph.cancelled(tasks.limit(0), edges), "node") == []


def test_facts_skip_years_and_texts_without_metric():
    assert facts.facts_in("资本充足率不得低于8.5%，自2024年起") == [("资本充足率", "8.5%", 8.5)]
    assert facts.facts_in("8%") == [] and facts.facts_in(None) == [] and facts.facts_in("8%", " CAR ") == [("car", "8%", 8.0)]


def test_bad_patterns_match_nothing(spark):
    d = spark.createDataFrame([("a(b",), (None,)], "v string")
    assert rows(d.filter(filters.predicate("v", "regex", "a(")), "v") == []
    found = filters.exact_match(d.select(F.lit(1).alias("chunk_id"), F.col("v").alias("content")), "a(", "regex")
    assert all(r.match_pos == -1 for r in found.collect())


def test_names_of_tables_by_common_parts(spark):
    asked = spark.createDataFrame([(1, "2023年资本表"), (2, "资本构成明细"), (3, "无关")], "ask_id int, text string")
    known = spark.createDataFrame([("2024年资本表",), ("资本构成明细表",)], "name string")
    assert rows(names.resolve_tables(asked, known), "ask_id", "name", "level") == [(2, "资本构成明细表", 3)]


def test_citations_of_nothing(spark):
    d = spark.createDataFrame([(None, None, None, None)], "kind string, doc string, metadata map<string,string>, told string")
    assert d.select(answers.citation(F.col("kind"), F.col("doc"), F.col("metadata"), F.col("told")).alias("c")).first().c == "《相关法规》"
