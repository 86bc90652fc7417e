"""Queries over questions, branches, sessions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import questions as q
from tessera.operators import branches, evidence
from tessera.plans.catalog import CHUNKS, HITS, chunks, hits, query
from tessera.sources.tables import read

TALK = "SELECT conv_id, turn, role"


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '([0-9]{4})', 1))) AS n_years, CASE WHEN contains(text, 'license') THEN 1 ELSE 0 END AS n_terms FROM documents")
def qu10_anchors(spark, sf):
    a = q.anchors(F.col("text"), (("year", "([0-9]{4})", 0.8),), terms=("license",))
    n = lambda k: F.size(F.filter(a, lambda x: x["kind"] == k))
    return read(spark, sf, "documents").select("doc_id", n("year").cast("long").alias("n_years"), n("term").alias("n_terms"))


@query("SELECT p_partkey, p_type || CASE WHEN contains(p_type, 'BRUSHED STEEL') THEN ' IRON' ELSE '' END || CASE WHEN contains(p_type, 'BRUSHED') AND NOT contains(p_type, 'BRUSHED STEEL') THEN ' MATTE' ELSE '' END || CASE WHEN contains(p_type, 'PROMO') THEN ' OFFER' ELSE '' END AS expanded FROM part")
def qu6_synonyms(spark, sf):
    more = q.expanded(F.col("p_type"), {"BRUSHED": ("MATTE",), "BRUSHED STEEL": ("IRON",), "PROMO": ("OFFER", "PROMO")})
    return read(spark, sf, "part").select("p_partkey", more.alias("expanded"))


@query(TALK + ", CASE WHEN contains(text, 'idiot') OR (regexp_matches(text, '[0-9]+') AND contains(text, 'most')) THEN 'high' ELSE 'medium' END AS risk FROM conversations")
def rte3_risk(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", q.risk(F.lit("threshold"), F.col("text"), ("idiot",), ("most",), "[0-9]+").alias("risk"))


@query(TALK + ", concat_ws(',', CASE WHEN contains(text, ' it ') THEN 'entity_ambiguous' END, CASE WHEN NOT contains(text, 'a') AND regexp_matches(text, 'how m') THEN 'scope_missing' END, CASE WHEN NOT contains(text, 'a') AND contains(text, 'bank') THEN 'term_polysemous' END) AS kinds FROM conversations")
def qu4_ambiguity(spark, sf):
    t = F.col("text")
    kinds = q.ambiguities(t, F.lit("threshold"), t.contains("a"), F.lit(True), (" it ",), "how m", ("bank",))
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.array_join(kinds, ",").alias("kinds"))


@query(f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM chunks), a AS (SELECT doc_id, any_value(lang) AS lang, string_agg('[' || n || '] ' || left(content, 150), chr(10) ORDER BY n) FILTER (WHERE n <= 5) AS body FROM r GROUP BY doc_id) SELECT doc_id, CASE lang WHEN 'en' THEN 'Found:' ELSE 'Gefunden:' END || chr(10) || body AS answer FROM a")
def gen2_answers(spark, sf):
    first = chunks(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).filter("n <= 5")
    d = first.groupBy("doc_id").agg(F.first("lang").alias("lang"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("texts"))
    return d.select("doc_id", q.answer(F.col("lang"), F.col("texts"), {"en": "Found:", "other": "Gefunden:", "none": "Nothing found."}).alias("answer"))


LINES = """WITH b AS (SELECT l_orderkey AS request_id, CASE l_linenumber WHEN 1 THEN 'exact' WHEN 2 THEN 'lexical' WHEN 3 THEN 'dense' WHEN 4 THEN 'table' ELSE 'relation' END AS channel, CASE WHEN l_linenumber = 1 THEN 'completed' ELSE 'running' END AS status, l_suppkey % 3 AS parent_id, CAST(l_discount AS DOUBLE) * 10 AS score FROM lineitem),
 u AS (SELECT request_id FROM b WHERE channel = 'exact' GROUP BY 1 HAVING count(*) = 1 AND max(score) >= 0.8), s AS (SELECT DISTINCT request_id FROM (SELECT request_id, parent_id FROM b WHERE channel IN ('lexical', 'dense') GROUP BY 1, 2 HAVING count(DISTINCT channel) = 2)), f AS (SELECT request_id, max(score) > 0.95 AS enough FROM b GROUP BY 1)
 SELECT b.request_id, channel, status, CASE WHEN status = 'running' AND CASE WHEN enough THEN true WHEN b.request_id IN (SELECT request_id FROM u) THEN channel IN ('dense', 'relation') WHEN b.request_id IN (SELECT request_id FROM s) THEN channel = 'table' ELSE false END THEN 'cancel' ELSE 'keep' END AS action FROM b JOIN f USING (request_id)"""


@query(LINES)
def spc2_cancel(spark, sf):
    n = F.col("l_linenumber")
    channel = F.when(n == 1, "exact").when(n == 2, "lexical").when(n == 3, "dense").when(n == 4, "table").otherwise("relation")
    b = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_id"), channel.alias("channel"), F.when(n == 1, "completed").otherwise("running").alias("status"), (F.col("l_suppkey") % 3).alias("parent_id"), (F.col("l_discount").cast("double") * 10).alias("score"))
    full = b.groupBy("request_id").agg(F.when(F.max("score") > 0.95, 0.9).otherwise(0.1).alias("sufficiency"))
    return branches.cancel(b.select("request_id", "channel", "status"), b, full)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n FROM conversations) SELECT conv_id, max(turn) AS last_turn, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS recent, (SELECT count(*) FROM conversations f WHERE f.conv_id = r.conv_id AND f.role = 'user') AS n_facts FROM r WHERE n <= 3 GROUP BY conv_id")
def str5_context(spark, sf):
    c = read(spark, sf, "conversations")
    return branches.session_context(c, c.filter("role = 'user'"))


@query(HITS + ", a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY md5(trim(content)) ORDER BY score DESC, idx) = 1) SELECT idx FROM a x WHERE NOT (length(content) >= 10 AND EXISTS (SELECT 1 FROM a y WHERE length(y.content) > length(x.content) AND contains(y.content, x.content)))")
def evd2_dedup_stages(spark, sf):
    """Ids, then contents, then contained contents, over all chunks."""
    return evidence.dedup_stages(hits(spark, sf))


@query("SELECT doc_id, '<' || source || '> ' || lang AS citation, lang || ': ' || n_chars || ' chars, source ' || source AS explained FROM documents")
def prj5_citation(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.concat(F.lit("<"), F.col("source"), F.lit("> "), F.col("lang")).alias("citation"), F.concat(F.col("lang"), F.lit(": "), F.col("n_chars").cast("string"), F.lit(" chars, source "), F.col("source")).alias("explained"))
