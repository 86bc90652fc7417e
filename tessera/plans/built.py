"""Queries of names, facts, graphs, shapes, answers, rewriting and the dispatcher, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import questions, rewriting, scalars
from tessera.operators import answers, dispatch, evidence, facts, graph, names, shapes, states, tables
from tessera.plans import planner, routing
from tessera.plans.catalog import CHUNKS, HITS, chunks, hits, query
from tessera.sources.tables import read

# Names ---------------------------------------------------------------------------------------------------------------

ASKED = """a AS (SELECT p_partkey AS ask_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '07. ' || p_name || '.pdf' WHEN 2 THEN substr(p_name, 3, 6) WHEN 3 THEN split_part(p_name, ' ', 2) || '_' || split_part(p_name, ' ', 1) ELSE 'no such name' END AS text FROM part)"""


@query(f"""WITH {ASKED}, n AS (SELECT p_partkey AS name_id, p_name AS name, replace(trim(p_name), ' ', '') AS own FROM part),
 p AS (SELECT ask_id, text, replace(regexp_replace(trim(text), '\\.pdf$', ''), ' ', '') AS plain FROM a),
 w AS (SELECT ask_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[ _-]+'), lambda x: length(x) >= 2))) AS word FROM p), k AS (SELECT ask_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 2),
 m AS (SELECT ask_id, name_id, 1 AS level FROM p JOIN n ON text = name UNION ALL SELECT ask_id, name_id, 2 FROM p JOIN n ON plain = own UNION ALL SELECT ask_id, name_id, 2 FROM p JOIN n ON plain = '07.' || own
  UNION ALL SELECT ask_id, name_id, 3 FROM p JOIN n ON contains(own, plain) AND length(plain) >= 2
  UNION ALL SELECT ask_id, name_id, 5 FROM (SELECT ask_id, name_id, count(*) AS n FROM w JOIN n ON contains(own, word) GROUP BY 1, 2) JOIN k USING (ask_id, n))
 SELECT ask_id, arg_min(name_id, (level, name_id)) AS name_id, min(level) AS level FROM m GROUP BY ask_id""")
def jn12_names(spark, sf):
    p = read(spark, sf, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    case = F.col("p_partkey") % 5
    text = F.when(case == 0, F.col("p_name")).when(case == 1, F.concat(F.lit("07. "), "p_name", F.lit(".pdf"))).when(case == 2, F.substring("p_name", 3, 6)).when(case == 3, F.concat(word(2), F.lit("_"), word(1))).otherwise("no such name")
    own = p.select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"))
    extra = own.select(F.concat(F.lit("07. "), "name").alias("alias"), "name_id")
    return names.resolve_documents(p.select(F.col("p_partkey").alias("ask_id"), text.alias("text")), own, extra=extra)


@query("""WITH a AS (SELECT n_nationkey AS ask_id, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN left(n_name, 4) ELSE '' END AS text FROM nation),
 m AS (SELECT ask_id, n_name AS name, CASE WHEN text = n_name THEN 1 WHEN lower(text) = lower(n_name) THEN 2 ELSE 3 END AS level, length(text) / length(n_name) AS score FROM a JOIN nation ON text <> '' AND contains(lower(n_name), lower(text)))
 SELECT ask_id, name, level, round(score, 6) AS score FROM m WHERE score > 0.4 QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY least(level, 3), score DESC, name) = 1""")
def jn13_table_names(spark, sf):
    """Names told whole, in other case, or by their beginnings of four letters; the share of the whole name is the score."""
    n = read(spark, sf, "nation")
    case = F.col("n_nationkey") % 4
    text = F.when(case == 0, F.col("n_name")).when(case == 1, F.lower("n_name")).when(case == 2, F.left("n_name", F.lit(4))).otherwise("")
    found = names.resolve_tables(n.select(F.col("n_nationkey").alias("ask_id"), text.alias("text")), n.select(F.col("n_name").alias("name")))
    return found.filter("level <= 3")


# Facts ---------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'rate' AS metric, p_size || '%' AS text, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'rate', CAST(p_partkey AS VARCHAR), CAST(p_partkey AS DOUBLE) FROM part")
def cfl1_facts(spark, sf):
    """Percentages, then bare numbers; a number before 年 is a year and no fact."""
    text = F.concat(F.lit("x "), F.col("p_size").cast("string"), F.lit("% y "), F.col("p_partkey").cast("string"), F.lit(" z 2024年"))
    p = read(spark, sf, "part").select("p_partkey", F.explode(facts.numeric_facts(text, F.lit("Rate"))).alias("f"))
    return p.select("p_partkey", "f.*")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '资本充足率' END AS metric, CASE WHEN p_size % 3 = 0 THEN p_size || '%' END AS text FROM part WHERE p_size % 3 = 0")
def cfl1_metrics(spark, sf):
    """The metric is the phrase before the comparator; without one that is two characters long there is no fact."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("一级，资本充足率不得低于"), F.col("p_size").cast("string"), F.lit("%"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%")))
    return read(spark, sf, "part").select("p_partkey", F.explode(facts.numeric_facts(text)).alias("f")).select("p_partkey", "f.metric", "f.text")


UNIT = "CASE {0} % 4 WHEN 0 THEN '%' WHEN 1 THEN 'BP' WHEN 2 THEN '' ELSE 'RMB' END"


def _unit(c: str) -> Column:
    return F.when(F.col(c) % 4 == 0, "%").when(F.col(c) % 4 == 1, "BP").when(F.col(c) % 4 == 2, "").otherwise("RMB")


@query(f"""WITH c AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, CAST(l_tax AS DOUBLE) AS value, {UNIT.format('l_linenumber')} AS unit FROM lineitem), e AS (SELECT l_orderkey, CAST(l_discount AS DOUBLE) AS value, {UNIT.format('l_suppkey')} AS unit FROM lineitem),
 m AS (SELECT c.*, max(CASE WHEN abs(e.value - c.value) <= 0.01 THEN CASE WHEN c.unit = '' OR e.unit = '' OR c.unit = e.unit THEN 1 ELSE 0 END END) AS fits FROM c JOIN e USING (l_orderkey) GROUP BY ALL)
 SELECT l_orderkey, l_linenumber, CASE WHEN fits = 0 THEN 'unit' ELSE 'value' END AS problem FROM m WHERE coalesce(fits, 0) = 0""")
def ver1_units(spark, sf):
    li = read(spark, sf, "lineitem")
    c = li.select("l_orderkey", F.struct("l_linenumber", "l_orderkey").alias("claim_id"), F.col("l_tax").cast("double").alias("value"), _unit("l_linenumber").alias("unit"))
    found = facts.unmet_numbers(c, li.select("l_orderkey", F.col("l_discount").cast("double").alias("value"), _unit("l_suppkey").alias("unit")), "l_orderkey")
    return found.select("l_orderkey", F.col("claim_id.l_linenumber").alias("l_linenumber"), "problem")


@query("""WITH s AS (SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey),
 c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ['rural'] WHEN 1 THEN ['rural', 'foreign'] ELSE [] END AS own, CASE s_suppkey % 4 WHEN 0 THEN ['all_banks'] WHEN 1 THEN ['rural'] WHEN 2 THEN ['foreign', 'city_commercial'] ELSE [] END AS known FROM s),
 u AS (SELECT *, CASE WHEN list_contains(known, 'all_banks') OR len(known) = 0 THEN [] ELSE list_filter(own, lambda x: NOT list_contains(known, x)) END AS gap FROM c)
 SELECT s_suppkey, array_to_string(gap, ',') AS uncovered, CASE WHEN len(own) = 0 THEN 'ok' WHEN len(known) = 0 THEN 'unknown' WHEN len(gap) > 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM u""")
def ver4_scope(spark, sf):
    s, k = read(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey")
    claim = F.when(k % 3 == 0, "农商行须").when(k % 3 == 1, "外资银行和农村信用社").otherwise("无")
    known = F.when(k % 4 == 0, "商业银行").when(k % 4 == 1, "农村商业银行").when(k % 4 == 2, "外国银行、城商行").otherwise("无")
    ev = s.select("s_suppkey", F.regexp_replace(known, "农村商业银行", "农商行").alias("text"))
    found = facts.check_scopes(s.select("s_suppkey", claim.alias("text")), ev, "s_suppkey")
    return found.select("s_suppkey", F.array_join("uncovered", ",").alias("uncovered"), "verdict")


CONFLICTED = """e AS (SELECT l_suppkey AS doc, CAST(l_partkey AS VARCHAR) AS metric, CAST(l_discount AS DOUBLE) AS value, l_returnflag AS level, CASE WHEN l_linestatus = 'F' THEN 'superseded' ELSE 'active' END AS status, CAST(l_shipdate AS DATE) AS effective, l_returnflag AS scope, CAST(l_orderkey AS VARCHAR) AS content FROM lineitem)"""


@query(f"""WITH {CONFLICTED}, g AS (SELECT metric AS subject, count(DISTINCT level) AS a, count(DISTINCT value) AS n FROM e GROUP BY 1), t AS (SELECT CAST(doc AS VARCHAR) AS subject, count(DISTINCT effective) AS n FROM e GROUP BY 1 HAVING count(DISTINCT effective) >= 2), v AS (SELECT CAST(doc AS VARCHAR) AS subject, count(DISTINCT content) AS n FROM e GROUP BY 1 HAVING count(DISTINCT status) = 2 AND count(DISTINCT content) > 1),
 d AS (SELECT scope, count(DISTINCT doc) AS n FROM e GROUP BY 1), s AS (SELECT CASE WHEN x.scope = y.scope THEN x.scope ELSE x.scope || ' > ' || y.scope END AS subject, CASE WHEN x.scope = y.scope THEN x.n ELSE x.n + y.n END AS n FROM d x JOIN d y ON contains(lower(x.scope), lower(y.scope)) WHERE x.scope <> y.scope OR x.n > 1)
 SELECT 1 AS priority, 'authority' AS kind, subject, a AS n FROM g WHERE a >= 2 AND n >= 2 UNION ALL SELECT 2, 'version', subject, n FROM v UNION ALL SELECT 3, 'temporal', subject, n FROM t UNION ALL SELECT 4, 'scope', subject, n FROM s UNION ALL SELECT 5, 'numeric', subject, n FROM g WHERE n >= 2""")
def cfl7_all(spark, sf):
    li = read(spark, sf, "lineitem")
    e = li.select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").cast("string").alias("metric"), F.col("l_discount").cast("double").alias("value"), F.col("l_returnflag").alias("level"), F.when(F.col("l_linestatus") == "F", "superseded").otherwise("active").alias("status"), F.to_date("l_shipdate").alias("effective"), F.col("l_returnflag").alias("scope"), F.col("l_orderkey").cast("string").alias("content"))
    return facts.all_conflicts(e).select("priority", "kind", "subject", "n")


# Answers -------------------------------------------------------------------------------------------------------------

INTENT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'threshold_query' WHEN '2-HIGH' THEN 'clause_query' WHEN '3-MEDIUM' THEN 'overview' WHEN '5-LOW' THEN 'comparison' END"


def _intent() -> Column:
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "threshold_query").when(p == "2-HIGH", "clause_query").when(p == "3-MEDIUM", "overview").when(p == "5-LOW", "comparison")


@query(f"""WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN ['own'] ELSE CASE {INTENT} WHEN 'threshold_query' THEN ['applicable_entity', 'metric_name', 'minimum_value', 'effective_date', 'exceptions', 'legal_basis'] WHEN 'clause_query' THEN ['clause_content', 'clause_no', 'source', 'normative_level'] WHEN 'comparison' THEN ['entity_a', 'entity_b', 'dimensions', 'differences', 'sources'] ELSE ['main_answer', 'source'] END END AS s FROM orders)
 SELECT o_orderkey, unnest(s) AS slot, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS n, unnest(s) NOT IN ('exceptions', 'normative_level') AS required FROM q""")
def clm1_slots(spark, sf):
    """Slots of each question; a template that the caller adds is named by a column and goes first."""
    q = read(spark, sf, "orders").select("o_orderkey", _intent().alias("intent"), F.when(F.col("o_orderkey") % 7 == 0, "added").otherwise("none").alias("template"))
    found = answers.claim_slots(q, "o_orderkey", template="template", templates={"added": (("own", "", True),)})
    return found.select("o_orderkey", "slot", "n", "required")


@query(f"""WITH q AS (SELECT o_orderkey, {INTENT} AS intent FROM orders), e AS (SELECT l_orderkey AS o_orderkey, string_agg(l_linenumber, ',' ORDER BY l_extendedprice DESC, l_linenumber) AS cited, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT o_orderkey, CASE intent WHEN 'clause_query' THEN '法条原文,适用范围,规范强度' WHEN 'overview' THEN '概述,要点,来源' WHEN 'comparison' THEN '对比维度,对象A,对象B,结论' ELSE '相关内容,来源' END AS sections, CASE intent WHEN 'comparison' THEN 'comparison' ELSE 'text_excerpt' END AS shape, coalesce(cited, '') AS cited, CAST(least(coalesce(n, 0), 5) AS INTEGER) AS n_required FROM q LEFT JOIN e USING (o_orderkey)""")
def gen1_plans(spark, sf):
    q = read(spark, sf, "orders").select("o_orderkey", _intent().alias("intent"))
    e = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("evidence_id"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("idx"))
    p = answers.answer_plans(q, e, "o_orderkey")
    return p.select("o_orderkey", F.array_join("sections", ",").alias("sections"), "shape", F.array_join(F.transform("evidence_order", lambda x: x.cast("string")), ",").alias("cited"), "n_required")


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '《' || p_name || '》第' || p_size || '条' WHEN 1 THEN '《' || p_name || '》第' || p_size || '页' WHEN 2 THEN '《' || p_name || '》第四条' WHEN 3 THEN '附件' || p_size WHEN 4 THEN '《' || p_name || '》' || p_brand WHEN 5 THEN '附件2 表' || p_size || ' 第3行' ELSE '表格数据' END AS citation FROM part""")
def gen4_citation(spark, sf):
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    key = F.when(k == 0, "clause_number").when(k == 1, "page_number").when(k == 5, "table_num").otherwise("none")
    told = F.when(k == 2, "见第 四 条").when(k == 3, F.concat(F.lit("附件"), n)).when(k == 4, F.col("p_brand")).when(k == 5, "附件 2，第3行")
    kind = F.when(k >= 5, "Table").otherwise("clause")
    return read(spark, sf, "part").select("p_partkey", answers.citation(kind, F.when(k == 6, "").otherwise(F.col("p_name")), F.create_map(key, n), told).alias("citation"))


@query("SELECT c_custkey, concat_ws(';', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'applicable_scope=' || c_mktsegment END, 'doc_name=' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'clause_number=第' || c_nationkey || '条' END, CASE WHEN c_custkey % 3 = 0 THEN 'attachment_no=附件' || c_nationkey END) AS filters FROM customer")
def flt15_question_filters(spark, sf):
    """A question's entities and scope as filters; the last of several document names counts."""
    n, key = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    e = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    some = F.array_compact(F.array(e("doc_name", F.lit("first")), e("doc_name", F.col("c_name")), F.when(key % 2 == 0, e("clause_number", n)), F.when(key % 3 == 0, e("attachment_no", n)), e("year", n)))
    scope = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    found = answers.question_filters(some, scope)
    return read(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(F.map_entries(found), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("filters"))


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS INTEGER) AS place FROM supplier QUALIFY place <= 20")
def srt2_urgent(spark, sf):
    s = answers.urgent_first(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey").limit(20)
    rows = s.agg(F.array_sort(F.collect_list(F.struct("s_nationkey", "s_suppkey"))).alias("a"))  # 20 rows
    return rows.select(F.posexplode("a").alias("i", "r")).select("r.s_suppkey", (F.col("i") + 1).alias("place"))


@query(HITS + " SELECT arg_max(chunk_id, (score, -idx)) AS chunk_id, max(score) AS score FROM h GROUP BY parent_id HAVING max(score) > 0.5")
def evd4_by_score(spark, sf):
    return evidence.by_score(evidence.parents(hits(spark, sf))).filter("score > 0.5").select("chunk_id", "score")


# Graphs and states ---------------------------------------------------------------------------------------------------


@query("SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'F')")
def dag2_ready(spark, sf):
    """Orders are tasks that need their lines."""
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    line = F.concat(F.lit("l"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    order = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    tasks = o.select(order("o_orderkey").alias("node"), F.lit("pending").alias("status")).unionByName(li.select(line.alias("node"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"))).groupBy("node").agg(F.max("status").alias("status"))  # lines that share a name are one task
    return graph.ready(tasks, li.select(order("l_orderkey").alias("node"), line.alias("needs")))


def _tree(spark, sf):
    """Regions, their nations and these nations' suppliers as tasks, each needing the one above."""
    r, n, s = (read(spark, sf, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = r.select(name("r", "r_regionkey").alias("node"), F.lit(0).alias("k")).union(n.select(name("n", "n_nationkey"), F.col("n_nationkey"))).union(s.select(name("s", "s_suppkey"), F.lit(0)))
    return nodes, n.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("needs")).union(s.select(name("s", "s_suppkey"), name("n", "s_nationkey")))


@query("SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1")
def dag2_cancelled(spark, sf):
    """A failed region cancels its nations and, through them, their suppliers."""
    nodes, edges = _tree(spark, sf)
    return graph.cancelled(nodes.select("node", F.when(F.col("node") == "r1", "failed").otherwise("pending").alias("status")), edges).select("node")


@query("""WITH n AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 1 THEN 'failed' WHEN 2 THEN 'timeout' ELSE 'completed' END AS outcome FROM nation)
 SELECT 'r' || r_regionkey AS node, 'completed' AS outcome FROM region UNION ALL SELECT 'n' || n_nationkey, outcome FROM n UNION ALL SELECT 's' || s_suppkey, CASE outcome WHEN 'completed' THEN 'completed' ELSE 'cancelled' END FROM supplier JOIN n ON n_nationkey = s_nationkey""")
def dag3_outcomes(spark, sf):
    """Nations fail or run out of time by themselves; only what needs them is cancelled."""
    nodes, edges = _tree(spark, sf)
    bad = F.col("node").startswith("n")
    result = F.when(bad & (F.col("k") % 5 == 1), "failed").when(bad & (F.col("k") % 5 == 2), "timeout").otherwise("ok")
    return graph.outcomes(nodes.select("node", result.alias("result")), edges)


@query("WITH f AS (SELECT conv_id, role, text, min(turn) AS t FROM conversations WHERE text <> '' GROUP BY ALL) SELECT conv_id, role, md5(string_agg(text, '|' ORDER BY t, text)) AS seen, last_turn FROM f JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1) USING (conv_id) GROUP BY conv_id, role, last_turn")
def str4_working_memory(spark, sf):
    m = states.working_memory(read(spark, sf, "conversations"), "conv_id", "turn", "role", "text", "turn")
    return m.select("conv_id", "role", F.md5(F.array_join("seen", "|")).alias("seen"), "last_turn")


@query("SELECT conv_id AS session_id, role AS fact_type, text AS content, turn AS created FROM conversations WHERE role = 'user'")
def str8_facts(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("fact_type"), F.col("text").alias("content"), F.col("turn").alias("created"))
    return states.facts_of(c, kind="user")


# Shapes --------------------------------------------------------------------------------------------------------------


def _phone() -> Column:
    return F.concat(F.lit("p"), F.col("s_nationkey").cast("string"))


def _raw(spark, sf):
    """Suppliers as raw chunks; even ones have a scope, those of nation 0 no metadata at all."""
    key = F.col("s_suppkey").cast("string")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    scope = F.when(F.col("s_suppkey") % 2 == 0, pair("applicable_scope", F.lit("all")))
    pairs = F.array_compact(F.array(pair("clause_number", key), scope, pair("phone", _phone()), pair("doc_name", F.col("s_name"))))
    m = F.when(F.col("s_nationkey") != 0, F.map_from_entries(pairs))
    return read(spark, sf, "supplier").select(key.alias("chunk_id"), F.lit("").alias("chunk_type"), F.when(F.col("s_suppkey") % 3 == 0, F.upper("s_name")).alias("content"), F.col("s_name").alias("hierarchy_path"), F.lit(None).cast("string").alias("parent_chunk_id"), m.alias("metadata"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS chunk_id, CASE WHEN s_nationkey <> 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS clause_number, CASE WHEN s_nationkey <> 0 AND s_suppkey % 2 = 0 THEN 'all' ELSE '全部' END AS applicable_scope, 'neutral' AS normative_level, CASE WHEN s_nationkey <> 0 THEN 'phone=p' || s_nationkey || ';doc_name=' || s_name ELSE '' END AS left_over FROM supplier")
def src6_promoted(spark, sf):
    p = shapes.promote(_raw(spark, sf))
    rest = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return p.select("chunk_id", "clause_number", "applicable_scope", "normative_level", rest.alias("left_over"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS chunk_id, 'clause' AS chunk_type, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS content, CASE WHEN s_nationkey <> 0 THEN s_name ELSE '' END AS doc_title, CASE WHEN s_nationkey <> 0 AND s_suppkey % 2 = 0 THEN 'all' ELSE '未指定' END AS applicable_scope, '[]' AS keywords, CASE WHEN s_nationkey <> 0 THEN 'phone=p' || s_nationkey ELSE '' END AS extra FROM supplier")
def prj2_flattened(spark, sf):
    extra = F.array_join(F.transform(F.map_entries("_extra"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return shapes.flatten(_raw(spark, sf)).select("chunk_id", "chunk_type", "content", "doc_title", "applicable_scope", "keywords", extra.alias("extra"))


@query(HITS + " SELECT chunk_id, 'request_id=r1;strategy=bm25;rank=' || idx || ';score=' || CAST(round(score, 4) AS VARCHAR) AS trace FROM h")
def prj4_trace(spark, sf):
    told = shapes.trace({"request_id": F.lit("r1"), "strategy": F.lit("bm25")}, {"rank": F.col("idx"), "score": F.round(F.col("score").cast("double"), 4)})
    return hits(spark, sf).select("chunk_id", F.array_join(F.transform(F.map_entries(told), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("trace"))


def _shown(spark, sf):
    p = read(spark, sf, "part")
    scope = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("applicable_scope"), F.col("p_type"))).otherwise(F.create_map(F.lit("attachment_no"), F.lit("附件1")))
    return p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").alias("rank"), F.lit("clause").alias("chunk_type"), F.col("p_name").alias("doc_name"), F.lit("f").alias("source_file"), F.repeat("p_name", F.lit(20)).alias("content"), F.col("p_brand").alias("citation"), F.lit(0.5).alias("score"), F.array(F.lit("bm25"), F.lit("dense")).alias("matched_by"), scope.alias("metadata"))


@query("SELECT p_partkey AS chunk_id, '[' || p_size || '] clause' || CASE WHEN p_size % 2 = 1 THEN ' 附件1' ELSE '' END || ' — ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' [适用: ' || p_type || ']' ELSE '' END || ' — ' || chr(10) || '    score=0.5000  matched_by=[''bm25'', ''dense'']  chunk_id=' || p_partkey AS line FROM part")
def prj6_explained(spark, sf):
    h = _shown(spark, sf)
    return h.select("chunk_id", shapes.explain(h).alias("line"))


@query("SELECT p_partkey AS chunk_id, left(repeat(p_name, 20), 300) AS content, left(repeat(p_name, 20), 500) AS tool_content, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS applicable_scope, CASE WHEN p_size % 2 = 1 THEN '附件1' ELSE '' END AS attachment_no FROM part")
def prj7_light(spark, sf):
    h = _shown(spark, sf)
    few = shapes.light(h).select("chunk_id", "content")
    return few.join(shapes.for_tools(h).select("chunk_id", F.col("content").alias("tool_content"), "applicable_scope", "attachment_no"), "chunk_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 200 OFFSET 5")
def snk5_page(spark, sf):
    """More than 200 rows a page are not given."""
    return shapes.page(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 1000, 5)


# Questions -----------------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '其中' || s_name || '是多少' WHEN 1 THEN '其中该比例是多少' WHEN 2 THEN '见第三条' ELSE s_name END AS text, s_suppkey % 4 = 0 OR s_suppkey % 4 = 2 AS resolved, s_suppkey % 4 = 1 AS ambiguous, CASE s_suppkey % 4 WHEN 0 THEN 'metric' WHEN 1 THEN 'metric' WHEN 2 THEN 'clause' END AS kind FROM supplier""")
def qu8_references(spark, sf):
    """One thing a reference may mean takes its place, several or none leave it."""
    k = F.col("s_suppkey") % 4
    text = F.when(k <= 1, "其中该比例是多少").when(k == 2, "见该条").otherwise(F.col("s_name"))
    metrics = F.when(k == 0, F.array("s_name")).when(k == 1, F.array(F.col("s_name"), _phone()))
    got = rewriting.resolved(text, metrics, F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<kind:string,value:string>>"), F.array(F.lit("问第三条")))
    return read(spark, sf, "supplier").select("s_suppkey", got.alias("g")).select("s_suppkey", "g.*")


@query("SELECT s_suppkey, '《' || s_name || '》第' || s_nationkey || '条 ratio' AS lexical, '《' || s_name || '》第' || s_nationkey || '条 ratio share' AS dense, 'p' || s_nationkey || ' 第' || s_nationkey || '条 《' || s_name || '》 ratio' AS exact FROM supplier WHERE s_nationkey > 0")
def qu7_channels(spark, sf):
    text = F.concat(F.lit("《"), F.col("s_name"), F.lit("》第"), F.col("s_nationkey").cast("string"), F.lit("条 ratio"))
    found = F.array(F.struct(F.lit("metric_name").alias("kind"), _phone().alias("value")), F.struct(F.lit("year").alias("kind"), F.lit("2024").alias("value")))
    q = read(spark, sf, "supplier").filter("s_nationkey > 0").select("s_suppkey", rewriting.channel_queries(text, found, {"ratio": ("share",)}).alias("q"))
    return q.select("s_suppkey", *(F.col("q")[c].alias(c) for c in ("lexical", "dense", "exact")))


@query("""WITH q AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'compliance' WHEN '2-HIGH' THEN 'comparison' WHEN '3-MEDIUM' THEN 'definition' WHEN '5-LOW' THEN 'greeting' ELSE 'other' END AS intent, o_orderkey % 3 = 0 AS unclear FROM orders),
 l AS (SELECT *, CASE intent WHEN 'compliance' THEN 'L4' WHEN 'comparison' THEN CASE WHEN unclear THEN 'L4' ELSE 'L3' END WHEN 'greeting' THEN 'L0' ELSE CASE WHEN unclear THEN 'L3' ELSE 'L2' END END AS level, CASE intent WHEN 'compliance' THEN 'high' WHEN 'comparison' THEN 'medium' WHEN 'other' THEN 'medium' ELSE 'low' END AS base FROM q)
 SELECT o_orderkey, level, CASE WHEN level = 'L4' AND base <> 'high' THEN 'high' WHEN level = 'L3' AND base = 'low' THEN 'medium' ELSE base END AS risk FROM l""")
def qu5_spec(spark, sf):
    p = F.col("o_orderpriority")
    intent = F.when(p == "1-URGENT", "compliance").when(p == "2-HIGH", "comparison").when(p == "3-MEDIUM", "definition").when(p == "5-LOW", "greeting").otherwise("other")
    unclear = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("scope_missing")))
    level = rewriting.complexity(intent, unclear)
    return read(spark, sf, "orders").select("o_orderkey", level.alias("level"), rewriting.raised_risk(questions.risk(intent, F.lit("")), level).alias("risk"))


DATES = "CASE o_orderkey % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y/%m/%d') WHEN 2 THEN strftime(d, '%Y年%m月%d日') WHEN 3 THEN strftime(d, '%Y%m%d') WHEN 4 THEN strftime(d, '%d/%m/%Y') ELSE '2024-13-01' END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 6 < 5 THEN CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-06-17' THEN 'before' WHEN CAST(o_orderdate AS DATE) > DATE '1995-06-17' THEN 'after' ELSE 'equal' END END AS comparison, CASE WHEN o_orderkey % 6 < 5 THEN CAST(abs(CAST(o_orderdate AS DATE) - DATE '1995-06-17') AS INTEGER) END AS days FROM orders")
def fn_dates(spark, sf):
    """Dates in five layouts; a day that does not exist is none."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    text = F.when(k == 5, "2024-13-01")
    for i, layout in enumerate(("yyyy-MM-dd", "yyyy/MM/dd", "yyyy'年'MM'月'dd'日'", "yyyyMMdd", "dd/MM/yyyy")):
        text = text.when(k == i, F.date_format(d, layout))
    how = scalars.compare_dates(text, F.lit("17/06/1995"))
    return read(spark, sf, "orders").select("o_orderkey", scalars.parse_date(text).alias("day"), how["comparison"].alias("comparison"), how["days"].alias("days"))


# Dispatch and plans --------------------------------------------------------------------------------------------------


def _engine(spark, sf):
    cells = read(spark, sf, "nation").groupBy(F.concat(F.lit("nations of "), F.col("n_regionkey").cast("string")).alias("table_id"))
    cells = cells.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("| %03d | %s |", "n_nationkey", "n_name"))), "\n").alias("rows"))
    parsed = tables.parse(cells.select("table_id", (-1 - F.substring("table_id", -1, 1).cast("long")).alias("chunk_id"), F.concat(F.lit("| key | name |\n|---|---|\n"), "rows").alias("content")))
    return dispatch.Engine(chunks(spark, sf), cells=parsed, substring_fields=("source",))


@query(f"""WITH {CHUNKS} SELECT 'metadata' AS strategy, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rank FROM chunks WHERE lang = 'de') WHERE rank <= 15
 UNION ALL SELECT 'relation', chunk_id, CAST(rank AS INTEGER) FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rank FROM chunks WHERE lang = 'fr') WHERE rank <= 15""")
def ret11_dispatch(spark, sf):
    """Two strategies of one entry; filters on fields are part of both."""
    e = _engine(spark, sf)
    ask = lambda strategy, lang: e.search(dispatch.Request(strategy=strategy, top_k=15, filters={"lang": lang}))
    return ask("metadata", "de").unionByName(ask("relation", "fr")).select(F.element_at("matched_by", 1).alias("strategy"), "chunk_id", "rank")


@query("SELECT -1 - r_regionkey AS chunk_id, 1 AS rank FROM region WHERE r_regionkey = 2")
def ret12_table(spark, sf):
    """The rows of the named table that have the pattern; no chunk of the corpus has it."""
    return _engine(spark, sf).search(dispatch.Request("", "table", 5, {"table_name": "Nations of 2"})).select("chunk_id", "rank")


ALL = "['exact', 'lexical', 'dense', 'metadata', 'table']"


@query(f"""WITH c AS (SELECT * FROM (VALUES ('exact', 50, 0.95, 0.8), ('lexical', 100, 0.85, 0.6), ('dense', 200, 0.80, 0.5), ('metadata', 30, 0.99, 0.3), ('table', 150, 0.90, 0.7)) t(name, lat, ok, gain)),
 p AS (SELECT * FROM (VALUES ('clause_query', 'base', 0, ['exact', 'metadata'], true), ('clause_query', 'lean', 1, ['exact'], true), ('table_lookup', 'base', 0, ['table', 'metadata'], false), ('table_lookup', 'lean', 1, ['table'], false), ('definition', 'base', 0, ['lexical', 'dense'], true)) t(intent, kind, place, channels, rerank)
  UNION ALL SELECT intent, unnest(['base', 'lean']), unnest([0, 1]), unnest([['lexical', 'dense', 'metadata'], ['lexical', 'dense']]), true FROM (VALUES ('threshold'), ('comparison'), ('unknown')) t(intent)
  UNION ALL SELECT intent, 'eager', 2, {ALL}, true FROM (VALUES ('clause_query'), ('table_lookup'), ('definition'), ('threshold'), ('comparison'), ('unknown')) t(intent)),
 k AS (SELECT intent, kind, place, max(lat) + CASE WHEN rerank THEN 500 ELSE 0 END AS lat, product(1 - gain) * CASE WHEN rerank THEN 0.8 ELSE 1 END AS miss, product(ok) * CASE WHEN rerank THEN 0.95 ELSE 1 END AS ok FROM (SELECT *, unnest(channels) AS name FROM p) JOIN c USING (name) GROUP BY intent, kind, place, rerank)
 SELECT intent, arg_min(kind, (lat + 200 * miss + 500 * (1 - ok), place)) AS kind, round(min(lat + 200 * miss + 500 * (1 - ok)), 4) AS cost FROM k GROUP BY intent""")
def pln5_choice(spark, sf):
    """Candidates of every template costed as a table of plans, the cheapest kept."""
    kinds = [(n, i, p) for n in (*planner.TEMPLATES, "unknown") for i, p in enumerate(planner.candidates(planner.Question(n)))]
    rows = [(f"{n}/{p.kind}/{i}", s, c, *planner.COSTS[c], stage.rerank) for n, i, p in kinds for s, stage in enumerate(p.stages) for c in stage.channels]
    ops = spark.createDataFrame(rows, "plan_id string, stage int, channel string, latency int, success double, gain double, rerank boolean")
    again = ops.filter("rerank").select("plan_id", "stage", F.lit("rerank").alias("channel"), F.lit(0).alias("latency"), F.lit(planner.COSTS["rerank"][1]).alias("success"), F.lit(planner.COSTS["rerank"][2]).alias("gain"), "rerank").distinct()
    parts = F.split("plan_id", "/")
    best = routing.plan_costs(ops.unionByName(again)).groupBy(parts[0].alias("intent")).agg(F.min(F.struct("cost", parts[2].cast("int"), parts[1].alias("kind"))).alias("b"))
    return best.select("intent", "b.kind", "b.cost")
