"""Queries of the remaining operators: stores, names, scopes, tables, claims, branches, folds and plans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import joins, links, tables
from tessera.plans import planner
from tessera.plans.catalog import BM25, CHUNKS, WORDS, bm25, chunks, query
from tessera.sources import store
from tessera.sources.tables import read
from tessera.streaming import folds

# Stores and filters --------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT c_nationkey, max(c_custkey) AS seq, max(c_custkey) AS c_custkey FROM customer GROUP BY 1), n AS (SELECT s_nationkey, max(s_suppkey) AS k FROM supplier GROUP BY 1)
 SELECT * FROM o WHERE c_nationkey NOT IN (SELECT s_nationkey FROM n) UNION ALL SELECT s_nationkey, k + 1 + (SELECT max(seq) FROM o), k FROM n""")
def src8_replace(spark, sf):
    old = links.latest(read(spark, sf, "customer"), "c_nationkey", ["c_custkey"], ["c_custkey"]).select("c_nationkey", F.col("c_custkey").alias("seq"), "c_custkey")
    new = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") + 1).alias("seq"), F.col("s_suppkey").alias("c_custkey"))
    return store.replace_rows(old, new, "c_nationkey", "seq")


@query(f"WITH {CHUNKS}, t AS (SELECT doc_id, lang, count(*) AS n FROM chunks GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_chunks, string_agg(lang || '=' || n, ',' ORDER BY lang) AS types FROM t GROUP BY doc_id")
def snk1_summaries(spark, sf):
    s = store.type_counts(chunks(spark, sf).withColumnRenamed("lang", "chunk_type"))
    shown = F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.select("doc_id", F.col("n_chunks").cast("long").alias("n_chunks"), F.array_join(shown, ",").alias("types"))


@query("SELECT 'text' AS rule, count(*) FILTER (WHERE coalesce(text, '') = '') AS n FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'de')) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE NOT coalesce(n_chars = length(text), false)) FROM documents")
def snk6_violations(spark, sf):
    return store.violations(read(spark, sf, "documents"), {"text": F.col("text") != "", "lang": F.col("lang").isin("en", "de"), "n_chars": F.col("n_chars") == F.length("text")})


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND source ILIKE '%src%' ORDER BY doc_id LIMIT 20 OFFSET 10")
def flt8_search_page(spark, sf):
    return read(spark, sf, "documents").filter((F.col("lang") == "en") & F.col("source").ilike("%src%")).select("doc_id", "source").orderBy("doc_id").offset(10).limit(20)


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt14_allowed(spark, sf):
    return chunks(spark, sf).join(read(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("chunk_id")


# Retrieval -----------------------------------------------------------------------------------------------------------


@query(BM25.replace("{k}", "30") + ", c AS (SELECT query_id, doc_id, rank, n_chars, count(*) OVER (PARTITION BY query_id) AS n FROM bm JOIN documents USING (doc_id)) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 THEN n_chars END DESC NULLS LAST, old) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, rank AS old, n_chars, n FROM c) QUALIFY rank <= 10")
def ret10_rerank(spark, sf):
    """A second scorer (here: the length) reorders the 30 best, only if there are more than are asked for."""
    w = Window.partitionBy("query_id")
    c = bm25(spark, sf, 30).select("query_id", "doc_id", F.col("rank").alias("old")).join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    c = c.withColumn("again", F.when(F.count(F.lit(1)).over(w) > 10, F.col("n_chars")))
    return c.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("again"), "old"))).filter("rank <= 10").select("query_id", "doc_id", "rank")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'exact' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'hybrid' WHEN o_orderpriority = '5-LOW' THEN 'dense' ELSE 'table' END AS strategy FROM orders")
def ret14_strategy(spark, sf):
    sets = {"1-URGENT": ("metadata", "exact"), "2-HIGH": ("lexical", "dense", "table"), "3-MEDIUM": ("dense", "lexical"), "4-NOT SPECIFIED": ("table", "metadata"), "5-LOW": ("dense", "metadata")}
    known = F.create_map(*(F.lit(x) for p, c in sets.items() for x in (p, planner.strategy(c))))
    return read(spark, sf, "orders").select("o_orderkey", F.element_at(known, F.col("o_orderpriority")).alias("strategy"))


# Links, names, scopes, numbers ---------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT c.chunk_id, p.chunk_id AS parent_id, length(p.content) AS parent_chars FROM chunks c LEFT JOIN chunks p ON p.doc_id = c.doc_id AND p.pos = 0 AND c.pos > 0")
def jn2_parents(spark, sf):
    c = chunks(spark, sf)
    roots = c.filter("pos = 0").select("doc_id", F.col("chunk_id").alias("parent_id"), F.length("content").cast("long").alias("parent_chars"))
    out = c.select("chunk_id", "doc_id", "pos").join(roots, "doc_id", "left")
    own = F.col("pos") > 0
    return out.select("chunk_id", F.when(own, F.col("parent_id")).alias("parent_id"), F.when(own, F.col("parent_chars")).alias("parent_chars"))


@query(f"WITH {CHUNKS} SELECT chunk_id, length(lag(content) OVER w) AS prev_chars, length(lead(content) OVER w) AS next_chars, count(*) OVER (PARTITION BY doc_id) - 1 AS n_siblings, source AS doc_source FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def jn7_context(spark, sf):
    w = Window.partitionBy("doc_id")
    size = lambda c: F.length(c).cast("long")
    o = w.orderBy("pos")
    return chunks(spark, sf).select("chunk_id", size(F.lag("content").over(o)).alias("prev_chars"), size(F.lead("content").over(o)).alias("next_chars"), (F.count(F.lit(1)).over(w) - 1).alias("n_siblings"), F.col("source").alias("doc_source"))


@query("WITH c AS (SELECT source AS scope, count(DISTINCT doc_id) AS n_docs FROM documents WHERE source <> '' GROUP BY 1) SELECT a.scope, b.scope AS inside, a.n_docs, b.n_docs AS n_inside FROM c a JOIN c b ON contains(lower(a.scope), lower(b.scope)) WHERE a.scope <> b.scope OR a.n_docs > 1")
def cfl3_scope_overlap(spark, sf):
    return joins.overlapping_scopes(read(spark, sf, "documents"), "doc_id", "source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem c WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey = c.l_orderkey AND abs(CAST(e.l_discount AS DOUBLE) - CAST(c.l_tax AS DOUBLE)) <= 0.01)")
def ver1_numbers(spark, sf):
    li = read(spark, sf, "lineitem")
    c = li.select("l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_tax").cast("double").alias("value"))
    return joins.unmatched_numbers(c, li.select("l_orderkey", F.col("l_discount").cast("double").alias("value")), "l_orderkey").select("claim_id.*")


# Tables --------------------------------------------------------------------------------------------------------------


def nation_tables(spark, sf):
    """Two chunks a region, each a Markdown table of its own header; the second one lacks a cell."""
    row = F.format_string("| %d | %s |", "n_nationkey", "n_name")
    text = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    first = text.select("table_id", F.lit(0).alias("chunk_id"), F.concat(F.lit("Nations\n| key | Name |\n|---|---|\n"), "rows").alias("content"))
    return tables.parse(first.unionByName(text.select("table_id", F.lit(1).alias("chunk_id"), F.lit("| key | x |\n| --- | --- |\n| 99 |").alias("content"))))


NATIONS = "WITH t AS (SELECT n_regionkey AS table_id, '| ' || n_nationkey || ' |' AS o, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, 0 AS c FROM nation UNION ALL SELECT r_regionkey, '', '99', '', 1 FROM region), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY c, o) - 1 AS INTEGER) AS row_index FROM t)"


@query(NATIONS + " SELECT table_id, row_index, name AS value FROM p")
def tab3_column(spark, sf):
    return tables.column(nation_tables(spark, sf), "NAM")


@query(NATIONS + " SELECT table_id, row_index, key, name FROM p")
def tab5_maps(spark, sf):
    return tables.as_maps(nation_tables(spark, sf)).select("table_id", "row_index", F.col("row")["key"].alias("key"), F.col("row")["Name"].alias("name"))


@query(NATIONS + " SELECT table_id, count(*) AS n_rows, 2 AS n_columns FROM p GROUP BY table_id")
def tab2_index(spark, sf):
    return tables.info(nation_tables(spark, sf))


# Aggregations, windows, sorting, sets --------------------------------------------------------------------------------


@query("SELECT coalesce(lang, 'all') AS lang, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def agg1_counts(spark, sf):
    return read(spark, sf, "documents").rollup("lang").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "n")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY user_id")
def agg10_sets(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("n_days"))
    return e


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents")
def win1_rank(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf, "documents").select("doc_id", "source", F.row_number().over(w).alias("rank"))


@query("WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) SELECT o_custkey, max(o_orderkey) AS o_orderkey, min(n) > 1 AS fell_back FROM v WHERE n <= 3 AND o_orderstatus <> 'F' GROUP BY 1")
def win6_checkpoints(spark, sf):
    payload = F.when(F.col("o_orderstatus") == "F", "{broken").otherwise('{"done": 1}')
    return folds.latest_readable(read(spark, sf, "orders").select("o_custkey", "o_orderkey", payload.alias("payload")), "o_custkey", "o_orderkey", "payload")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def srt1_top(spark, sf):
    return read(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("SELECT user_id, max(value) AS value, arg_max(event_id, (value, -event_id)) AS event_id FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY user_id")
def dd4_merge_branches(spark, sf):
    e = read(spark, sf, "events").filter("user_id IS NOT NULL AND value IS NOT NULL").select("user_id", "value", "event_id")
    return joins.merge_branches(e, "user_id", "value", "event_id")


@query("WITH c AS (SELECT l_orderkey, l_returnflag AS kind, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS ids FROM lineitem GROUP BY 1, 2) SELECT min(l_orderkey) AS idx, kind, ids FROM c GROUP BY kind, ids")
def dd6_conflicts(spark, sf):
    c = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("idx"), F.col("l_returnflag").alias("kind")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("ids"))
    return joins.dedup_conflicts(c).select("idx", "kind", F.array_join("ids", ",").alias("ids"))


@query("SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def set1_union(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("key")).unionByName(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"))).distinct()


# Evidence, claims, answers -------------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(nullif(source, ''), left(text, 200)) AS snippet, left(text, 200) AS head, CASE WHEN quality = 0 THEN 'superseded' ELSE 'active' END AS version_status FROM documents LEFT JOIN labels USING (doc_id)")
def evd1_evidence(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    head = F.left("text", F.lit(200))
    state = F.coalesce(F.when(F.col("quality") == 0, "superseded"), F.lit("active"))
    return d.select("doc_id", F.coalesce(F.nullif("source", F.lit("")), head).alias("snippet"), head.alias("head"), state.alias("version_status"))


@query(f"""WITH s AS (SELECT item_id AS claim_id, unnest(list_distinct({WORDS.format("text")})) AS word FROM benchmark), e AS (SELECT doc_id, unnest(list_distinct({WORDS.format("text")})) AS word FROM documents),
 m AS (SELECT DISTINCT claim_id, doc_id FROM s JOIN e USING (word) WHERE length(word) >= 2), r AS (SELECT claim_id, doc_id AS evidence_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY doc_id) AS INTEGER) AS rank, false AS fallback FROM m QUALIFY rank <= 3)
 SELECT * FROM r UNION ALL SELECT item_id, (SELECT min(doc_id) FROM documents), 1, true FROM benchmark WHERE item_id NOT IN (SELECT claim_id FROM r)""")
def evd5_bind(spark, sf):
    return joins.bind_claims(read(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("description")), read(spark, sf, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("content")))


@query("SELECT source AS doc, string_agg(DISTINCT CASE WHEN quality = 1 THEN 'active' ELSE 'superseded' END, ',' ORDER BY CASE WHEN quality = 1 THEN 'active' ELSE 'superseded' END) AS states FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1 AND bool_or(quality = 0)")
def evd6_simple_version(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    s = d.groupBy(F.col("source").alias("doc")).agg(F.array_sort(F.collect_set(F.when(F.col("quality") == 1, "active").otherwise("superseded"))).alias("states"))
    return s.filter((F.size("states") > 1) & F.array_contains("states", "superseded")).select("doc", F.array_join("states", ",").alias("states"))


@query("SELECT source AS bundle_id, round(avg(quality), 6) AS coverage, round(coalesce(avg(quality) FILTER (WHERE toxic = 0), 1.0), 6) AS required_coverage FROM documents JOIN labels USING (doc_id) GROUP BY source")
def suf1_coverage(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    need = F.avg(F.when(F.col("toxic") == 0, F.col("quality")))
    return d.groupBy(F.col("source").alias("bundle_id")).agg(F.round(F.avg("quality"), 6).alias("coverage"), F.round(F.coalesce(need, F.lit(1.0)), 6).alias("required_coverage"))


@query("SELECT conv_id, turn, role, text LIKE '%?%?%' AS several, len(list_filter(string_split(text, '?'), lambda p: trim(p) <> '')) AS n_parts FROM conversations")
def qu9_decompose(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").like("%?%?%").alias("several"), F.size(F.filter(F.split("text", r"\?"), lambda p: F.trim(p) != "")).cast("long").alias("n_parts"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 30000 WHEN '2-HIGH' THEN 15000 WHEN '3-MEDIUM' THEN 3000 ELSE 5000 END AS budget_ms, CASE o_orderpriority WHEN '1-URGENT' THEN 'L4' WHEN '2-HIGH' THEN 'L3' ELSE 'L2' END AS level FROM orders")
def rte1_routes(spark, sf):
    intent = F.when(F.col("o_orderpriority") == "1-URGENT", "compliance").when(F.col("o_orderpriority") == "2-HIGH", "comparison").when(F.col("o_orderpriority") == "3-MEDIUM", "table_lookup").otherwise("no such intent")
    table = F.create_map(*(x for k, r in planner.ROUTES.items() for x in (F.lit(k), F.struct(F.lit(r[0]).alias("level"), F.lit(r[5]).alias("budget_ms")))))
    route = F.coalesce(F.element_at(table, intent), F.element_at(table, F.lit("unknown")))
    return read(spark, sf, "orders").select("o_orderkey", route["budget_ms"].alias("budget_ms"), route["level"].alias("level"))


# Plans, branches, folds ----------------------------------------------------------------------------------------------


@query("SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS tier, max(value) AS score FROM events GROUP BY 1, 2")
def spc1_branches(spark, sf):
    tier = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return read(spark, sf, "events").groupBy("user_id", tier.alias("tier")).agg(F.max("value").alias("score"))


@query("SELECT user_id, event_id, CASE WHEN value >= 85 THEN 'sufficient' WHEN used > 1000 THEN 'budget' WHEN gain < 5 THEN 'gain' ELSE 'continue' END AS action FROM (SELECT user_id, event_id, value, sum(1) OVER w * 100 AS used, greatest(0, value - lag(value) OVER w) AS gain FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def spc3_early_stop(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("used", F.row_number().over(w) * 100).withColumn("gain", F.greatest(F.lit(0.0), F.col("value") - F.lag("value").over(w)))
    first = F.lag("value").over(w).isNull()
    gain = F.when(first & F.col("gain").isNull(), None).otherwise(F.col("gain"))
    return e.select("user_id", "event_id", F.when(F.col("value") >= 85, "sufficient").when(F.col("used") > 1000, "budget").when(gain < 5, "gain").otherwise("continue").alias("action"))


@query("")
def str1_rate_limit_memory(spark, sf):
    return folds.rate_limit(read(spark, sf, "events").select("event_id", "user_id", "ts"), 2, 86_400).select("event_id", "user_id", "allowed")


@query("")
def str3_idempotent(spark, sf):
    return folds.idempotent(read(spark, sf, "events").select("event_id", "user_id", "ts"), 86_400).select("event_id", "user_id", "stored")


@query("WITH s AS (SELECT l_orderkey AS span_id, any_value(o_custkey) AS parent_id, count(*) AS n_events, bool_or(l_returnflag = 'R') AS failed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) SELECT s.*, coalesce(k.n, 0) AS n_children FROM s LEFT JOIN (SELECT parent_id, count(*) AS n FROM s GROUP BY 1) k ON k.parent_id = s.span_id")
def str9_spans(spark, sf):
    log = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return folds.span_tree(log.select(F.col("l_orderkey").alias("span_id"), F.col("o_custkey").alias("parent_id"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("INFO").alias("level")))
