"""More queries: understanding, routing, claims, verification, metrics of conversations and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import claims, evidence
from tessera.plans.catalog import BEST, CHUNKS, HITS, WORDS, best_of_parents, chunks, hits, query
from tessera.sources.tables import read

INTENTS = [("question", r"\?$", 0.9), ("definition", r"(?i)^the ", 0.7), ("table", r"\|", 0.8), ("threshold", r"\d+", 0.6)]


@query("""WITH m AS (SELECT conv_id, turn, role, text, [x for x in [CASE WHEN regexp_matches(text, '\\?$') THEN {'c': 0.9, 'f': 0, 'i': 'question'} END, CASE WHEN regexp_matches(text, '(?i)^the ') THEN {'c': 0.7, 'f': -1, 'i': 'definition'} END,
 CASE WHEN regexp_matches(text, '\\|') THEN {'c': 0.8, 'f': -2, 'i': 'table'} END, CASE WHEN regexp_matches(text, '\\d+') THEN {'c': 0.6, 'f': -3, 'i': 'threshold'} END] if x IS NOT NULL] AS h FROM conversations)
 SELECT conv_id, turn, role, coalesce(list_max(h).i, 'unknown') AS intent, coalesce(round(list_max(h).c::DOUBLE * CASE WHEN len(h) > 1 THEN 0.85 ELSE 1.0 END, 6), 0.3)::DOUBLE AS confidence FROM m""")
def qu1_intent(spark, sf):
    found = rules.intent(F.col("text"), INTENTS)
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", found["intent"].alias("intent"), found["confidence"].alias("confidence"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n_numbers, len(list_distinct(regexp_extract_all(text, '[a-z]+@[a-z]+'))) AS n_mails FROM documents")
def qu2_entities(spark, sf):
    e = rules.entities(F.col("text"), {"number": "[0-9]+", "mail": "[a-z]+@[a-z]+"})
    n = lambda k: F.size(F.filter(e, lambda x: x["kind"] == k)).cast("long")
    return read(spark, sf, "documents").select("doc_id", n("number").alias("n_numbers"), n("mail").alias("n_mails"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 'rude' WHEN contains(lower(text), 'license') THEN 'legal' END AS label FROM documents")
def qu3_constraints(spark, sf):
    return read(spark, sf, "documents").select("doc_id", rules.first_of(F.col("text"), {"rude": ("idiot", "scum"), "legal": ("license",)}).alias("label"))


@query("SELECT o_orderkey, 'P' || greatest(least(lv + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, 4), CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 ELSE 0 END) AS path FROM (SELECT *, o_orderkey % 5 AS lv FROM orders)")
def rte4_path(spark, sf):
    level = F.concat(F.lit("L"), (F.col("o_orderkey") % 5).cast("string"))
    risk = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("low")
    up = rules.bumped(level, F.when(F.col("o_orderstatus") == "O", 1).otherwise(0))
    return read(spark, sf, "orders").select("o_orderkey", rules.path(up, risk).alias("path"))


@query(f"""WITH s AS (SELECT item_id AS claim_id, unnest(list_distinct({WORDS.format("text")})) AS word FROM benchmark), e AS (SELECT doc_id, CAST(n_chars % 97 AS DOUBLE) AS score, unnest(list_distinct({WORDS.format("text")})) AS word FROM documents),
 m AS (SELECT DISTINCT claim_id, doc_id, score FROM s JOIN e USING (word) WHERE length(word) >= 2) SELECT claim_id, doc_id AS evidence_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 3""")
def clm3_fill_slots(spark, sf):
    slots = read(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("description"))
    ev = read(spark, sf, "documents").select(F.col("doc_id").alias("evidence_id"), (F.col("n_chars") % 97).cast("double").alias("score"), F.col("text").alias("content"))
    return claims.fill_slots(slots, ev)


@query("SELECT p_partkey AS answer_id, CASE WHEN p_partkey % 3 = 0 THEN 5 WHEN p_partkey % 3 = 1 THEN 22 ELSE 4 END AS n_cited, array_to_string(list_filter([CASE WHEN p_size > 20 THEN CAST(p_size AS VARCHAR) END, CASE p_partkey % 3 WHEN 0 THEN '99999999999999999999' WHEN 1 THEN '1-2000000000' END], lambda c: c IS NOT NULL), ',') AS out_of_range, CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE 0 END AS n_named FROM part WHERE p_size > 20")
def ver3_citations(spark, sf):
    """Numbers too long to be one and ranges of billions end no query: they are out of range as written."""
    more = F.when(F.col("p_partkey") % 3 == 0, "[99999999999999999999]").when(F.col("p_partkey") % 3 == 1, "[1-2000000000]").otherwise("(来源: a) (引用：b c )")
    a = read(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("answer_id"), F.concat(F.lit("a [1-2] b [3, "), F.col("p_size").cast("string"), F.lit("]"), more).alias("text"), F.lit(20).alias("n_evidence"))
    return claims.check_citations(a)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate > DATE '1997-01-01' THEN 'error' WHEN l_returnflag = 'R' AND l_shipdate + INTERVAL 365 DAY <= DATE '1997-01-01' THEN 'error' WHEN l_returnflag = 'R' THEN 'warning' ELSE 'ok' END AS verdict FROM lineitem")
def ver2_versions(spark, sf):
    until = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 365 DAYS"))
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("1997-01-01").cast("timestamp_ntz").alias("asked"), F.col("l_shipdate").cast("timestamp_ntz").alias("effective"), until.cast("timestamp_ntz").alias("superseded"))
    return claims.check_versions(rows).select("l_orderkey", "l_linenumber", "verdict")


@query(f"""WITH s AS (SELECT conv_id * 1000 + turn AS answer_id, sentence, row_number() OVER () AS sid FROM (SELECT conv_id, turn, role, unnest(regexp_split_to_array(text, '[.!?。！？\\n]')) AS sentence FROM conversations WHERE role = 'assistant') WHERE length(trim(sentence)) >= 5),
 w AS (SELECT answer_id, sid, unnest(list_distinct({WORDS.format("sentence")})) AS word FROM s), k AS (SELECT DISTINCT conv_id * 1000 + turn + 1 AS answer_id, unnest({WORDS.format("text")}) AS word FROM conversations WHERE role = 'user'),
 e AS (SELECT s.answer_id, s.sid, count(w.word) AS n, count(k.word) AS h FROM s LEFT JOIN w USING (answer_id, sid) LEFT JOIN k ON k.answer_id = w.answer_id AND k.word = w.word GROUP BY 1, 2),
 t AS (SELECT answer_id, count(*) AS n, count(*) FILTER (WHERE NOT (h >= 2 OR h >= 0.3 * greatest(n, 1))) AS unsupported FROM e GROUP BY 1)
 SELECT answer_id, n, unsupported, CASE WHEN unsupported > n // 2 THEN 'refuse' WHEN unsupported > 0 THEN 'retry' ELSE 'accept' END AS verdict FROM t""")
def ver5_sentences(spark, sf):
    c = read(spark, sf, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return claims.check_sentences(c.filter("role = 'assistant'").select(key.alias("answer_id"), "text"), c.filter("role = 'user'").select((key + 1).alias("answer_id"), F.col("text").alias("content")))


@query("SELECT conv_id, CAST(place AS INTEGER) AS at, n_turns, n_chars FROM (SELECT conv_id, row_number() OVER o AS place, count(*) OVER w AS n_turns, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text), w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE place % 5 = 0")
def win4_summaries(spark, sf):
    return claims.summaries(read(spark, sf, "conversations"))


@query(HITS + ", f AS (SELECT h.parent_id, score, min(idx) AS first FROM h GROUP BY 1, 2) SELECT parent_id, score, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY first, score) AS INTEGER) AS number FROM f")
def dd7_citations(spark, sf):
    return claims.citations_numbered(hits(spark, sf), "parent_id", "idx", "score")


@query(f"WITH {CHUNKS} SELECT lang AS entity_type, source AS value, max(length(content)) AS confidence FROM chunks GROUP BY 1, 2")
def dd5_entities(spark, sf):
    return chunks(spark, sf).groupBy(F.col("lang").alias("entity_type"), F.col("source").alias("value")).agg(F.max(F.length("content")).cast("long").alias("confidence"))


@query("SELECT l_partkey, count(DISTINCT l_discount) AS n_values, count(DISTINCT l_shipdate) AS n_levels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_discount) >= 2 AND count(DISTINCT l_returnflag) >= 2")
def cfl5_authority(spark, sf):
    g = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_discount").alias("n_values"), F.count_distinct("l_shipdate").alias("n_levels"), F.count_distinct("l_returnflag").alias("f"))
    return g.filter("n_values >= 2 AND f >= 2").drop("f")


@query("SELECT doc_id, len(p) AS n, round(list_sum(p), 4) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), lambda v: CAST(v AS DOUBLE)) AS p FROM documents) WHERE len(p) > 0")
def cfl1_percents(spark, sf):
    p = rules.percents(F.col("text"))
    d = read(spark, sf, "documents").select("doc_id", p.alias("p")).filter("size(p) > 0")
    return d.select("doc_id", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("SELECT source AS bundle_id, round(least(count(*) / 3.0, 1) * avg(quality) * (1 - 0.1 * count(*) FILTER (WHERE toxic = 1 AND doc_id % 7 = 0)), 6)::DOUBLE AS score FROM documents JOIN labels USING (doc_id) GROUP BY source")
def evd7_simple_sufficiency(spark, sf):
    e = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    n = F.count(F.lit(1))
    bad = F.sum(((F.col("toxic") == 1) & (F.col("doc_id") % 7 == 0)).cast("int"))
    return e.groupBy(F.col("source").alias("bundle_id")).agg(F.round(F.least(n / 3.0, F.lit(1.0)) * F.avg("quality") * (1 - 0.1 * bad), 6).alias("score"))


@query(HITS + ", a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY md5(trim(content)) ORDER BY score DESC, idx) = 1)" + BEST.format("a"))
def evd8_bundle(spark, sf):
    return best_of_parents(evidence.dedup_contents(evidence.dedup_ids(hits(spark, sf))))
