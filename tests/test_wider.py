"""Names, numbers, tables, folds, stores, planner and tools on small cases with results worked out by hand."""

import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import tools
from tessera.operators import joins, tables
from tessera.plans import planner, routing
from tessera.sources import store
from tessera.sources.tables import read
from tessera.streaming import folds

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def by_user(spark):
    out = defaultdict(list)
    for r in read(spark, SF, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").collect():
        out[r.user_id].append((r.t, r.event_id))
    return out


def test_rate_limit_equals_a_plain_loop(spark):
    want = set()
    for events in by_user(spark).values():
        kept = []
        for t, e in sorted(events):
            if sum(k > t - 86_400_000_000 for k in kept) < 2:
                kept.append(t)
                want.add(e)
    got = registry.queries()["str1_rate_limit_memory"](spark, SF).collect()
    assert {r.event_id for r in got if r.allowed} == want and len(got) == read(spark, SF, "events").count()


def test_idempotent_equals_a_plain_loop(spark):
    want = set()
    for events in by_user(spark).values():
        last = None
        for t, e in sorted(events):
            if last is None or t - last > 86_400_000_000:
                last = t
                want.add(e)
    got = registry.queries()["str3_idempotent"](spark, SF).collect()
    assert {r.event_id for r in got if r.stored} == want and len(got) == read(spark, SF, "events").count()


def test_names_prefer_lower_levels_and_smaller_ids(spark):
    names = spark.createDataFrame([(1, "Basel Accord"), (2, "basel accord"), (3, "Accord"), (4, None)], "name_id int, name string")
    asked = spark.createDataFrame([(1, "Basel Accord"), (2, "BASEL ACCORD"), (3, "cord"), (4, "the accord of"), (5, "zzz"), (6, ""), (7, None)], "ask_id int, text string")
    assert rows(joins.resolve_names(asked, names), "ask_id", "name_id", "level") == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 3, 4)]


def test_scopes_of_classes(spark):
    d = spark.createDataFrame([(1, "bank"), (2, "state bank"), (3, "bank"), (4, ""), (5, None), (6, "fund")], "doc int, scope string")
    assert rows(joins.overlapping_scopes(d, "doc", "scope"), "scope", "inside", "n_docs", "n_inside") == [("bank", "bank", 2, 2), ("state bank", "bank", 1, 2)]


def test_numbers_within_tolerance_and_nulls(spark):
    c = spark.createDataFrame([("g", 1, 8.0), ("g", 2, 8.02), ("h", 3, 8.0), ("g", 4, None)], "g string, claim_id int, value double")
    e = spark.createDataFrame([("g", 8.005), ("g", None)], "g string, value double")
    assert rows(joins.unmatched_numbers(c, e, "g"), "claim_id") == [(2,), (3,), (4,)]


def test_claims_fall_back_to_the_first_evidence(spark):
    s = spark.createDataFrame([(1, "capital ratio"), (2, "zzz"), (3, None)], "claim_id int, description string")
    e = spark.createDataFrame([(i, "the ratio") for i in range(5)], "evidence_id int, content string")
    assert rows(joins.bind_claims(s, e), "claim_id", "evidence_id", "fallback") == [(1, 0, False), (1, 1, False), (1, 2, False), (2, 0, True), (3, 0, True)]
    assert joins.bind_claims(s, e.limit(0)).count() == 0


def test_tables_take_the_header_before_the_last_separator(spark):
    text = "intro\n| a | b |\n|---|---|\n| 1 | 2 |"
    c = spark.createDataFrame([("t", 1, text), ("t", 2, "| x |\n| 3 |"), ("u", 1, "a | b"), ("v", 1, None)], "table_id string, chunk_id int, content string")
    t = tables.parse(c)
    assert rows(t, "table_id", "row_index", "cells") == [("t", 0, ["1", "2"]), ("t", 1, ["3", ""])]
    assert rows(tables.column(t, "B"), "value") == [("",), ("2",)]
    assert rows(tables.find_rows(t, "3", "a"), "row_index") == [(1,)] and tables.find_rows(t, "zz").count() == 0
    assert [r["row"] for r in tables.as_maps(t).orderBy("row_index").collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": ""}]


def test_tables_of_many_chunks_are_never_whole_in_a_task(spark):
    c = spark.range(400).select((F.col("id") % 3).alias("table_id"), F.floor(F.col("id") / 3).alias("chunk_id"), F.concat(F.lit("| k |\n|---|\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: F.concat(F.lit("| "), (F.col("id") * 10 + i).cast("string"), F.lit(" |"))), "\n")).alias("content"))
    t = tables.parse(c)
    for table in range(3):
        told = sorted((r.row_index, r.cells[0]) for r in t.filter(F.col("table_id") == table).collect())
        assert told == list(enumerate(str(i * 10 + k) for i in range(table, 400, 3) for k in range(i % 5 + 1)))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate posexplode\(body#\d+\), \[\d+\]", plan), "the lines of a chunk go along with each of its rows"
    assert not re.search(r"Window \[row_number\(\) windowspecdefinition\(table_id#\d+, chunk_id#\d+ ASC", plan), "a table's rows are numbered in one task"


def test_checkpoints_fall_back_to_readable_versions(spark):
    c = spark.createDataFrame([("s", 1, "{}"), ("s", 2, "{}"), ("s", 3, "{x"), ("t", 1, "{x"), ("u", 9, None)], "s string, v int, p string")
    assert rows(folds.latest_readable(c, "s", "v", "p"), "s", "v", "fell_back") == [("s", 2, True)]


def test_replaced_rows_move_to_the_end(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, seq long, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("a", 2, "w"), ("c", 3, "q")], "id string, seq long, v string")
    assert rows(store.replace_rows(old, new, "id", "seq"), "seq", "id", "v") == [(2, "b", "y"), (4, "a", "w"), (5, "c", "q")]


def test_store_round_trip_cache_and_golden_set(spark, tmp_path):
    (tmp_path / "d_summary.json").write_text('{"doc_id": "d", "doc_name": "D",\n "parse_timestamp": ""}')
    s = store.read_summaries(spark, str(tmp_path))
    c = spark.createDataFrame([("d", "1", "clause", {"parse_timestamp": "2024"}), ("d", "2", "table", {})], "stem string, chunk_id string, chunk_type string, metadata map<string,string>")
    assert rows(store.pair(s, c), "doc_id", "parse_timestamp", "n_chunks") == [("d", "2024", 2)]
    store.export_documents(c.withColumnRenamed("stem", "doc_id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/chunks")).count() == 2
    store.export_tables(s, c.drop("metadata"), str(tmp_path / "both"), "parquet")
    assert spark.read.parquet(str(tmp_path / "both/chunks")).count() == 2
    (tmp_path / "g.jsonl").write_text(json.dumps({"query_id": "q", "relevant": ["a", "b"]}) + "\n")
    assert rows(store.read_golden(spark, str(tmp_path / "g.jsonl")), "query_id", "item") == [("q", "a"), ("q", "b")]
    key, built = store.content_key(c, "stem", "chunk_id"), []
    assert key == store.content_key(c.orderBy(F.desc("chunk_id")), "stem", "chunk_id") != store.content_key(c.limit(1), "stem", "chunk_id")
    for _ in range(2):
        assert store.cached(spark, lambda: built.append(1) or c, key, str(tmp_path / "cache")).count() == 2
    assert built == [1]


def test_planner_candidates_costs_and_cache(spark):
    q = planner.Question("threshold", (planner.Claim("c1"), planner.Claim("c2")), "high")
    assert [p.kind for p in planner.candidates(q)] == ["base", "lean", "eager"]
    assert planner.logical(q) == ("retrieve", "verify_c1", "verify_c2")
    assert planner.cost(planner.physical(planner.Question("table_lookup")))[0] == 150
    assert planner.validate(planner.choose(q), q) == []
    broken = planner.Plan("x", (planner.Stage("retrieve", ("dense",), 0, False, 0),), {})
    assert len(planner.validate(broken, q)) == 5
    assert planner.strategy(("metadata", "lexical", "dense")) == "hybrid" and planner.strategy(()) == "hybrid" and planner.strategy(("neighborhood", "table")) == "relation"
    now = [0.0]
    cache = planner.PlanCache(10, lambda: now[0])
    cache.put(q, planner.choose(q))
    assert cache.get(planner.Question("threshold", q.claims[::-1], "high")) == planner.choose(q)
    now[0] = 10.0
    assert cache.get(q) is None and cache.hit_rate == 0.5
    cache.put(q, broken)
    cache.invalidate()
    assert cache.get(q) is None
    assert routing.CHANNELS == {k: v[:2] for k, v in planner.COSTS.items() if k != "rerank"}


def test_tools(spark):
    waits, tries = [], []

    def flaky(args):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no answer")
        return "done"

    def broken(args):
        raise OSError("down")

    reg = tools.Registry((*tools.BUILT_IN, tools.Tool("flaky", flaky), tools.Tool("secret", flaky, permission="restricted"), tools.Tool("broken", broken, idempotent=False, fallback=lambda a: "instead")))
    ex = tools.Executor(reg, sleep=waits.append)
    assert ex.run("calculator", {"expression": "8 * (1.25 + 1) - 7 % 4"}) == {"result": 15.0}
    assert ex.run("calculator", {"actual": "8", "threshold": 8})["compliant"]
    assert ex.run("date_parser", {"text": "2024年3月5日"}) == {"date": "2024-03-05"}
    assert ex.run("version_checker", {"effective": "2020-01-01", "day": "2023-01-01", "superseded": "2023-01-01"}) == {"in_force": False}
    assert ex.run("flaky", {}) == ex.run("flaky", {}) == "done" and waits == [0.5, 1.0] and len(tries) == 3
    assert ex.run("broken", {}) == "instead"
    for name, args in (("secret", {}), ("date_parser", {}), ("nothing", {}), ("calculator", {"expression": "__import__('os')"}), ("calculator", {"expression": "1 / 0"})):
        with pytest.raises(tools.ToolError):
            ex.run(name, args)
    with pytest.raises(tools.ToolError):
        reg.add(tools.BUILT_IN[0])
    assert [a["state"] for a in ex.audit].count("cached") == 1


def test_questions_in_the_rules_own_language(spark):
    from tessera.functions import questions as q

    d = spark.createDataFrame([(1, "《资本办法》第43条 8%"), (2, "那个要求是多少"), (3, ""), (4, None), (5, "CAR 不得低于多少")], "id int, t string")
    t = F.col("t")
    out = {r.id: r for r in d.select("id", q.anchors(t).alias("a"), q.enhanced(t, q.anchors(t)).alias("e"), q.risk(F.lit("definition"), t).alias("r"), q.ambiguities(t, F.lit("threshold"), F.lit(False), F.lit(True)).alias("k"), q.expanded(t, {"CAR": ("资本充足率",)}).alias("x")).collect()}
    assert [a.value for a in out[1].a] == ["资本办法", "43", "8%"] and out[1].e == "资本办法 43 《资本办法》第43条 8%"
    assert out[3].a == [] == out[4].a
    assert (out[1].r, out[5].r, out[4].r) == ("low", "high", "low")
    assert out[2].k == ["entity_ambiguous", "scope_missing"] and out[1].k == [] == out[4].k
    assert out[5].x == "CAR 不得低于多少 资本充足率"
    none = spark.createDataFrame([("x", ["a", "b"]), ("x", [])], "i string, t array<string>")
    assert [r[0] for r in none.select(q.answer(F.col("i"), F.col("t"), {"other": "Found:", "none": "Nothing."}, 1)).collect()] == ["Found:\n[1] a", "Nothing."]
