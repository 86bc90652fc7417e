"""Queries of the library by operator id, each with SQL that another engine runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars
from tessera.operators import evidence, filters, graph, links, measures, retrieval, states, tables
from tessera.plans import routing
from tessera.sources.tables import lines_as_chunks, read, upsert, wide_vectors
from tessera.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str]] = {}

CHUNKS = """chunks AS (
  SELECT doc_id * 4294967296 + pos AS chunk_id, doc_id, pos, content, source, lang FROM (
    SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(content) <> '')"""
WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


def query(sql: str, name: str = ""):
    def keep(f: Query) -> Query:
        CATALOG[name or f.__name__] = (f, sql)
        return f

    return keep


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return lines_as_chunks(read(spark, sf, "documents"))


# Sources and projections ---------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT c.chunk_id, c.doc_id, length(c.content) AS n_content, d.n_chars AS doc_chars FROM chunks c LEFT JOIN documents d USING (doc_id)")
def src11_scan_join(spark, sf):
    return links.with_documents(chunks(spark, sf), read(spark, sf, "documents")).select("chunk_id", "doc_id", F.length("content").cast("long").alias("n_content"), "doc_chars")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def src7_upsert(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 <> 0"), "o_custkey", "o_orderkey")


@query("SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def src9_incremental(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", "c_name").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(f"WITH {CHUNKS} SELECT c.chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 0)")
def src10_delete_cascade(spark, sf):
    bad = read(spark, sf, "labels").filter("quality = 0").select("doc_id")
    return chunks(spark, sf).join(bad, "doc_id", "left_anti").select("chunk_id")


@query("SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS emb_{i}" for i in range(64)) + " FROM embeddings")
def snk3_wide_vectors(spark, sf):
    w = wide_vectors(read(spark, sf, "embeddings"), 64)
    return w.select("vec_id", "label", *(F.col(f"emb_{i}").cast("double").alias(f"emb_{i}") for i in range(64)))


@query("SELECT doc_id, coalesce(nullif(text, ''), nullif(source, ''), '') AS index_text FROM documents")
def prj1_index_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalars.present(F.col("text"), F.col("source")).alias("index_text"))


@query(f"WITH {CHUNKS} SELECT chunk_id, left(content, 300) AS content, length(content) > 300 AS cut, source || ' > ' || lang || ' > ' || pos AS citation FROM chunks")
def prj3_hit_shape(spark, sf):
    c = chunks(spark, sf)
    return c.select("chunk_id", F.substring("content", 1, 300).alias("content"), (F.length("content") > 300).alias("cut"), F.concat_ws(" > ", "source", "lang", F.col("pos").cast("string")).alias("citation"))


@query("""SELECT item_id, substr(sha256('{"item_id": ' || item_id || ', "text": ' || to_json(text) || '}'), 1, 16) AS fingerprint FROM benchmark""")
def prj8_fingerprint(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", scalars.fingerprint(text=F.col("text"), item_id=F.col("item_id")).alias("fingerprint"))


@query("SELECT n_nationkey, 'nation' || chr(10) || 'key | name' || chr(10) || '---' || chr(10) || 'key: ' || n_nationkey || ', name: ' || n_name AS block FROM nation")
def prj9_row_block(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", F.format_string("nation\nkey | name\n---\nkey: %d, name: %s", "n_nationkey", "n_name").alias("block"))


# Filters -------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_partkey LIMIT 100")
def flt1_metadata(spark, sf):
    p = read(spark, sf, "part")
    brand = p.agg(F.min("p_brand")).first()[0]
    return filters.metadata_filter(p, {"p_brand": ("eq", brand), "unknown": ("eq", "x"), "p_type": ("eq", "")}, "p_partkey", 100).select("p_partkey", "p_name")


def _flt(op: str, field: str, value: object, where: str) -> None:
    @query(f"SELECT doc_id, source FROM documents WHERE {where}", name=f"flt_{op}_{field}")
    def run(spark, sf):
        return read(spark, sf, "documents").filter(filters.predicate(field, op, value, ("source",))).select("doc_id", "source")


_flt("eq", "source", "SRC1", "contains(lower(source), 'src1')")
_flt("eq", "lang", "en", "lang = 'en'")
_flt("in", "lang", ("de", "es"), "lang IN ('de', 'es')")
_flt("contains", "text", "the ", "contains(lower(text), 'the ')")
_flt("regex", "source", "^src1[0-4]$", "regexp_matches(source, '^src1[0-4]$')")
_flt("prefix", "source", "SRC2", "starts_with(lower(source), 'src2')")
_flt("suffix", "source", "5", "ends_with(lower(source), '5')")
_flt("gt", "n_chars", 1000, "n_chars > 1000")
_flt("lte", "n_chars", 500, "n_chars <= 500")
def _flt_keywords(name: str, op: str, value: object, where: str) -> None:
    @query(f"SELECT doc_id, source FROM (SELECT *, lang || ' ' || source || ' Tag' || doc_id % 3 AS words FROM documents) WHERE {where}", name=f"flt_{name}_keywords")
    def run(spark, sf):
        words = F.array("lang", "source", F.concat(F.lit("Tag"), (F.col("doc_id") % 3).cast("string")))
        return read(spark, sf, "documents").withColumn("keywords", words).filter(filters.predicate("keywords", op, value)).select("doc_id", "source")


_flt_keywords("eq", "eq", "n src1", "contains(words, 'n src1')")
_flt_keywords("in", "in", ["tag0", "Tag1", "de src1"], "contains(words, 'Tag1') OR contains(words, 'de src1')")
_flt_keywords("contains", "contains", ["c3 Tag2", "es", "TAG"], "contains(words, 'c3 Tag2') OR contains(words, 'es')")
_flt("lt", "n_chars", 300, "n_chars < 300")
_flt("gte", "source", 1, "TRY_CAST(source AS DOUBLE) >= 1")


@query("SELECT doc_id, source, 1 AS level FROM documents WHERE lang = 'en'")
def flt9_relax(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "lang")
    return filters.relax(d, [{"lang": ("eq", "en"), "source": ("eq", "no such name")}, {"lang": ("eq", "en")}, {}]).select("doc_id", "source", "level")


@query(f"WITH {CHUNKS} SELECT chunk_id, 1.0::DOUBLE AS score, 0 AS match_pos FROM chunks WHERE lower(trim(content)) = (SELECT lower(trim(content)) FROM chunks ORDER BY chunk_id LIMIT 1)")
def flt10_exact(spark, sf):
    c = chunks(spark, sf)
    return filters.exact_match(c, c.orderBy("chunk_id").first()["content"], "exact")


@query(f"WITH {CHUNKS}, m AS (SELECT chunk_id, lower(content) AS c FROM chunks) SELECT chunk_id, least((length(c) - length(replace(c, 'ing', ''))) // 3, 10) / 10.0::DOUBLE AS score, CAST(instr(c, 'ing') - 1 AS INTEGER) AS match_pos FROM m WHERE contains(c, 'ing')")
def flt11_contains(spark, sf):
    return filters.exact_match(chunks(spark, sf), "ing", "contains")


@query(f"WITH {CHUNKS}, m AS (SELECT chunk_id, len(regexp_extract_all(content, '(?i)th[aeo]r')) AS n, content FROM chunks) SELECT chunk_id, least(n, 10) / 10.0::DOUBLE AS score, CAST(instr(lower(content), lower(regexp_extract(content, '(?i)th[aeo]r'))) - 1 AS INTEGER) AS match_pos FROM m WHERE n > 0")
def flt12_regex(spark, sf):
    return filters.exact_match(chunks(spark, sf), "th[aeo]r", "regex")


@query("SELECT doc_id, 1.0::DOUBLE AS score, 0 AS match_pos FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: starts_with(lower(trim(x)), 'the'))) > 0")
def flt13_prefix(spark, sf):
    return filters.exact_match(read(spark, sf, "documents"), "the", "prefix", "text", "doc_id")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def flt16_field_counts(spark, sf):
    return filters.field_counts(read(spark, sf, "documents"), "source")


# Retrieval -----------------------------------------------------------------------------------------------------------

BM25 = f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
 st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
 p AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY ALL),
 t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
 s AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM q JOIN t USING (term) JOIN p USING (term) CROSS JOIN st GROUP BY ALL),
 bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= {{k}})"""


def bm25(spark, sf, k):
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25_search(read(spark, sf, "documents"), q, k)


@query(f"SELECT doc_id, len(ws) AS n, md5(array_to_string(ws, ' ')) AS words FROM (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents)")
def ret1_tokens(spark, sf):
    w = scalars.tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("words"))


@query(BM25.replace("{k}", "10").split(",\n q AS")[0] + " SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM t CROSS JOIN st")
def ret2_bm25_index(spark, sf):
    return retrieval.bm25_index(read(spark, sf, "documents"))[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query(BM25.replace("{k}", "10") + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM bm")
def ret3_bm25(spark, sf):
    return bm25(spark, sf, 10).select("query_id", "doc_id", "rank")


KNN = """kn AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
 kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM kn WHERE score > 0 QUALIFY rank <= {k})"""


def knn(spark, sf, k):
    e = read(spark, sf, "embeddings")
    return retrieval.knn(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query("WITH " + KNN.format(k=10) + " SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM kr")
def ret5_knn(spark, sf):
    return knn(spark, sf, 10).select("query_id", "vec_id", "rank")


RRF = BM25.replace("{k}", "20") + ", " + KNN.format(k=20) + """,
 u AS (SELECT query_id, doc_id, 1.0 / (rank + 60) AS part FROM bm UNION ALL SELECT query_id // 100, vec_id, 1.0 / (rank + 60) FROM kr),
 f AS (SELECT query_id, doc_id, round(sum(part), 6) AS score, count(*) AS channels FROM u GROUP BY ALL)
 SELECT query_id, doc_id, score, channels, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10"""


@query(RRF)
def ret9_hybrid_rrf(spark, sf):
    dense = knn(spark, sf, 20).select((F.col("query_id") / 100).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.rrf([bm25(spark, sf, 20).select("query_id", "doc_id", "rank"), dense], 10)


@query(BM25.replace("{k}", "10") + ", c AS (SELECT query_id, doc_id, rank, sum(least(n_chars, 1000)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM (SELECT bm.*, length(text) AS n_chars FROM bm JOIN documents USING (doc_id))) SELECT query_id, doc_id, CAST(used AS BIGINT) AS used FROM c WHERE used <= 3000")
def ret15_pack_context(spark, sf):
    hits = bm25(spark, sf, 10).join(read(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return retrieval.pack_context(hits).select("query_id", "doc_id", "used")


@query(BM25.replace("{k}", "10") + " SELECT doc_id, min(query_id) AS query_id FROM bm GROUP BY doc_id")
def ret17_multi_query(spark, sf):
    return evidence.first_by(bm25(spark, sf, 10), F.col("doc_id"), [F.col("query_id"), F.col("rank")]).select("doc_id", "query_id")


# Joins, links, tables ------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_children, min(chunk_id) AS first_child, max(chunk_id) AS last_child FROM chunks GROUP BY doc_id")
def jn3_children(spark, sf):
    return links.children(chunks(spark, sf))


@query(f"WITH {CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def jn8_auto_link(spark, sf):
    return links.auto_link(chunks(spark, sf)).select("chunk_id", "prev_id", "next_id")


@query(f"WITH {CHUNKS} SELECT a.chunk_id, b.chunk_id AS sibling_id FROM chunks a JOIN chunks b USING (doc_id) WHERE a.pos = 0")
def jn5_siblings(spark, sf):
    c = chunks(spark, sf)
    return links.siblings(c, c.filter("pos = 0"))


@query(f"WITH {CHUNKS}, n AS (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS at FROM chunks) SELECT a.chunk_id, CAST(b.at - a.at AS INTEGER) AS distance, b.chunk_id AS near_id FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.at BETWEEN a.at - 2 AND a.at + 2")
def jn6_surrounding(spark, sf):
    c = chunks(spark, sf)
    return links.surrounding(c, c)


@query("SELECT r_name, n_name, count(s_suppkey) AS n_suppliers FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name")
def jn1_left_join(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.join(read(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@query("SELECT o_orderkey, CASE WHEN l.first_ship <= o_orderdate + INTERVAL 60 DAY THEN 'valid' ELSE 'not yet effective' END AS state FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def jn16_as_of(spark, sf):
    first = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    o = read(spark, sf, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.when(F.col("first_ship") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"), "valid").otherwise("not yet effective").alias("state"))


@query("SELECT n_regionkey AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_index, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def tab1_markdown(spark, sf):
    """Render each region's nations as a Markdown table, then parse the text into rows again."""
    row = F.format_string("| %d | %s |", "n_nationkey", "n_name")
    text = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rows"))
    text = text.select(F.col("n_regionkey").alias("table_id"), F.concat(F.lit("| key | name |\n|---|---|\n"), F.array_join(F.col("rows.row"), "\n")).alias("content"))
    parsed = tables.parse(text.withColumn("chunk_id", F.lit(0)))
    return parsed.select("table_id", F.col("row_index").cast("long").alias("row_index"), F.get("cells", 1).alias("name"), F.get("cells", 0).alias("key"))


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(concat_ws(' ', CAST(s_suppkey AS VARCHAR), s_name)), '00')")
def tab4_row_search(spark, sf):
    return read(spark, sf, "supplier").filter(F.lower(F.concat_ws(" ", F.col("s_suppkey").cast("string"), "s_name")).contains("00")).select("s_suppkey")


# Aggregations, windows, sets -----------------------------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS n, avg(n_chars) AS mean_chars FROM documents GROUP BY lang, source")
def agg2_distribution(spark, sf):
    return read(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


@query("SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def agg3_latest(spark, sf):
    return links.latest(read(spark, sf, "documents"), "source", ["doc_id"], ["doc_id", "n_chars"])


METRICS = "WITH " + KNN.format(k=11) + """, h AS (SELECT query_id, vec_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM kr WHERE vec_id <> query_id),
 rel AS (SELECT a.vec_id AS query_id, b.vec_id AS item FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1), g AS (SELECT query_id, rank FROM h JOIN rel USING (query_id, item) WHERE rank <= 10),
 p AS (SELECT n.query_id, any_value(n_rel) AS n_rel, coalesce(1 / min(rank), 0) AS rr, """ + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0) AS g{k}" for k in (1, 3, 5, 10)) + """ FROM n LEFT JOIN g USING (query_id) GROUP BY n.query_id)
 SELECT round(avg(rr), 4) AS mrr, count(*) AS n_queries, """ + ", ".join(f"round(avg(h{k} / n_rel), 4) AS recall_{k}, round(avg(h{k} / {k}), 4) AS precision_{k}, round(avg(g{k} / list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda i: 1 / log2(i + 1)))), 4) AS ndcg_{k}" for k in (1, 3, 5, 10)) + " FROM p"


@query(METRICS)
def agg4_ranking_metrics(spark, sf):
    e = read(spark, sf, "embeddings")
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = knn(spark, sf, 11).filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("item"), F.row_number().over(w).alias("rank"))
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("class"))
    return measures.class_metrics(hits, e.select(F.col("vec_id").alias("item"), F.col("label").alias("class")), asked)


@query("SELECT event_type, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, max(value) FILTER (WHERE place = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE place = floor(n * 0.95)) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def agg5_latency(spark, sf):
    return measures.latency_stats(read(spark, sf, "events"), "value", "event_type")


BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
HIST = " UNION ALL ".join(f"SELECT event_type, {b}::DOUBLE AS bound, count(*) FILTER (WHERE value <= {b}) AS n, count(*) AS total FROM events GROUP BY event_type" for b in BOUNDS)


@query(HIST)
def agg7_histogram(spark, sf):
    return measures.cumulative_histogram(read(spark, sf, "events"), "value", BOUNDS, "event_type")


@query(f"SELECT event_type, coalesce(min(bound) FILTER (WHERE n >= 0.5 * total), max(bound)) AS percentile FROM ({HIST}) GROUP BY event_type")
def agg8_percentile(spark, sf):
    return measures.histogram_percentile(agg7_histogram(spark, sf), "event_type", 0.5)


@query(f"SELECT event_type, coalesce(min(bound) FILTER (WHERE n >= 0.999 * total), max(bound)) AS percentile FROM ({HIST}) WHERE bound <= 5 GROUP BY event_type")
def agg8_percentile_beyond(spark, sf):
    """Most values lie beyond the last bound, so that it is the answer."""
    return measures.histogram_percentile(agg7_histogram(spark, sf).filter("bound <= 5"), "event_type", 0.999)


@query("SELECT event_type, count(value) AS total, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, " + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{i}" for i, b in enumerate(BOUNDS[:3])) + " FROM events GROUP BY 1")
def agg7_sums(spark, sf):
    return measures.summed_histogram(read(spark, sf, "events"), "value", BOUNDS[:3], "event_type")


@query("SELECT user_id, event_type, count(*) AS n, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY user_id, event_type")
def agg9_counter_gauge(spark, sf):
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 3")
def win3_last_turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return read(spark, sf, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("conv_id", "turn", "role")


@query("SELECT user_id, event_id, greatest(0, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gain FROM events")
def win7_marginal_gain(spark, sf):
    last = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gain = F.greatest(F.lit(0.0), F.coalesce(F.col("value") - last, F.lit(0.0)))
    return read(spark, sf, "events").select("user_id", "event_id", gain.alias("gain"))


HITS = f"WITH {CHUNKS}, h AS (SELECT chunk_id AS idx, content, doc_id AS parent_id, chunk_id, CAST(length(content) % 97 AS DOUBLE) AS score FROM chunks)"


def hits(spark, sf):
    c = chunks(spark, sf)
    return c.select(F.col("chunk_id").alias("idx"), "content", F.col("doc_id").alias("parent_id"), "chunk_id", (F.length("content") % 97).cast("double").alias("score"))


@query("SELECT min(doc_id) AS idx, source AS chunk_id FROM documents GROUP BY source")
def dd1_dedup_ids(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("chunk_id"))
    return evidence.dedup_ids(d)


@query(HITS + " SELECT idx, score FROM h QUALIFY row_number() OVER (PARTITION BY md5(trim(content)) ORDER BY score DESC, idx) = 1")
def dd2_dedup_contents(spark, sf):
    return evidence.dedup_contents(hits(spark, sf)).select("idx", "score")


@query("WITH c AS (SELECT conv_id * 1000 + turn AS idx, text AS content FROM conversations), l AS (SELECT DISTINCT content FROM c WHERE length(content) >= 10) SELECT idx FROM c WHERE NOT (length(content) >= 10 AND EXISTS (SELECT 1 FROM l WHERE length(l.content) > length(c.content) AND contains(l.content, c.content)))")
def dd3_dedup_contained(spark, sf):
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("content"))
    return evidence.dedup_contained(c).select("idx")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set2_intersect(spark, sf):
    o = read(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set3_except(spark, sf):
    return read(spark, sf, "part").select("p_partkey").subtract(read(spark, sf, "lineitem").filter("l_quantity > 45").select("l_partkey"))


# Evidence ------------------------------------------------------------------------------------------------------------


BEST = " SELECT parent_id, arg_max(chunk_id, (score, -idx)) AS chunk_id, max(score) AS score, count(*) AS n_children, string_agg(chunk_id, ',' ORDER BY idx) AS children FROM {0} GROUP BY parent_id"


def best_of_parents(found: DataFrame) -> DataFrame:
    p = evidence.parents(found)
    parent = F.substring_index("group_key", ":", -1).cast("long")
    return p.select(parent.alias("parent_id"), "chunk_id", "score", F.size("children").cast("long").alias("n_children"), F.array_join("children", ",").alias("children"))


@query(HITS + BEST.format("h"))
def evd3_parents(spark, sf):
    return best_of_parents(hits(spark, sf))


@query("SELECT l_partkey, count(DISTINCT l_discount) AS n_values, min(l_discount) AS least_value, max(l_discount) AS most_value FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_discount) >= 2")
def cfl2_numeric(spark, sf):
    return evidence.mismatches(read(spark, sf, "lineitem"), "l_partkey", "l_discount")


@query("SELECT d.source AS doc, count(DISTINCT text) AS n_contents FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source HAVING bool_or(quality = 1) AND bool_or(quality = 0) AND count(DISTINCT text) > 1")
def cfl4_version(spark, sf):
    e = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return evidence.version_conflicts(e.select(F.col("source").alias("doc"), F.col("text").alias("content"), F.when(F.col("quality") == 1, "active").otherwise("superseded").alias("version_status")))


@query("SELECT o_custkey, count(DISTINCT o_orderdate) AS n_values, min(o_orderdate) AS least_value, max(o_orderdate) AS most_value FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderdate) >= 2")
def cfl6_temporal(spark, sf):
    return evidence.mismatches(read(spark, sf, "orders"), "o_custkey", "o_orderdate")


SUFFICIENCY = """WITH e AS (SELECT source AS bundle_id, lang, quality, toxic, doc_id FROM documents JOIN labels USING (doc_id)),
 a AS (SELECT bundle_id, avg(CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.9 WHEN 'de' THEN 0.75 ELSE 0.4 END) AS authority, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.3 END) AS version, count(DISTINCT lang) AS channels,
         avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS coverage, count(*) FILTER (WHERE doc_id % 50 = 0) AS missing, count(*) FILTER (WHERE toxic = 1) * 0.12 AS penalty FROM e GROUP BY 1),
 s AS (SELECT *, round(greatest(0, least(1, 0.3 * coverage + 0.15 * authority + 0.2 * version + 0.15 * greatest(0, 1 - 0.15 * missing) + 0.2 * (CASE WHEN channels >= 2 THEN 1.0 WHEN channels = 1 THEN 0.7 ELSE 0 END) - penalty - least(0.3, 0.05 * missing))), 6) AS score FROM a)
 SELECT bundle_id, round(coverage, 6) AS coverage, round(authority, 6) AS authority, round(version, 6) AS version, CAST(score AS DOUBLE) AS score, score >= 0.85 AS sufficient FROM s"""


@query(SUFFICIENCY)
def suf6_sufficiency(spark, sf):
    e = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").withColumnRenamed("source", "bundle_id")
    level = F.when(F.col("lang") == "en", "law").when(F.col("lang") == "fr", "regulation").when(F.col("lang") == "de", "department_rule").otherwise("other")
    ev = e.select("bundle_id", level.alias("level"), F.when(F.col("quality") == 1, "active").otherwise("superseded").alias("version_status"), F.col("lang").alias("channel"))
    claims = e.select("bundle_id", (F.col("quality") == 1).alias("supported"), (F.col("doc_id") % 50 == 0).alias("missing"))
    return evidence.sufficiency(ev, claims, e.filter("toxic = 1").select("bundle_id", F.lit("numeric").alias("kind")))


# Planning and streams as batch plans ---------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey AS plan_id, o_orderpriority AS stage, max(50 + o_orderkey % 7 * 10) + max(CASE WHEN o_orderstatus = 'F' THEN 500 ELSE 0 END) AS lat, product(1 - (o_orderkey % 5) / 10.0) AS miss, product(0.95) AS ok FROM orders GROUP BY 1, 2),
 p AS (SELECT plan_id, sum(lat) AS latency, 1 - product(miss) AS gain, product(ok) AS success FROM s GROUP BY 1)
 SELECT plan_id, CAST(latency AS BIGINT) AS latency, round(gain, 6) AS gain, round(success, 6) AS success, round(latency + 200 * (1 - gain) + 500 * (1 - success), 4) AS cost FROM p""")
def pln4_costs(spark, sf):
    o = read(spark, sf, "orders")
    return routing.plan_costs(o.select(F.col("o_custkey").alias("plan_id"), F.col("o_orderpriority").alias("stage"), (50 + F.col("o_orderkey") % 7 * 10).alias("latency"), F.lit(0.95).alias("success"), ((F.col("o_orderkey") % 5) / 10.0).alias("gain"), (F.col("o_orderstatus") == "F").alias("rerank")))


@query("SELECT 'r' || r_regionkey AS node, 0 AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier")
def dag1_layers(spark, sf):
    r, n, s = (read(spark, sf, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = r.select(name("r", "r_regionkey").alias("node")).union(n.select(name("n", "n_nationkey"))).union(s.select(name("s", "s_suppkey")))
    edges = n.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("needs")).union(s.select(name("s", "s_suppkey"), name("n", "s_nationkey"))).union(s.select(name("s", "s_suppkey"), F.lit("unknown")))
    return graph.layers(edges, nodes)


@query("SELECT event_id, used, CASE WHEN used > 1000 THEN 'stop' WHEN used >= 800 THEN 'downgrade' ELSE 'continue' END AS action FROM (SELECT event_id, CAST(sum(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS used FROM events)")
def bud1_budget(spark, sf):
    e = read(spark, sf, "events").withColumn("tokens", F.col("event_id") % 50)
    return routing.budget_actions(e, 1000, "user_id", "event_id", "tokens").select("event_id", "used", "action")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window, in_window > 10 AS refused FROM events")
def str1_rate_limit(spark, sf):
    return streams.sliding_counts(read(spark, sf, "events")).select("event_id", "in_window", (F.col("in_window") > 10).alias("refused"))


@query("SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS f FROM events)")
def str2_sessions(spark, sf):
    return streams.sessions(read(spark, sf, "events")).select("event_id", "session")


@query("SELECT conv_id, max(turn) AS last_turn, count(DISTINCT role) AS n_roles, count(DISTINCT text) AS n_texts FROM conversations GROUP BY conv_id")
def str4_memory_fold(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count_distinct("role").alias("n_roles"), F.count_distinct("text").alias("n_texts"))


STATE_OF = "(['" + "', '".join(states.STATES) + "'])[CAST(event_id * 7 % 17 + 1 AS INTEGER)]"
LEGAL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, some in states.MOVES.items() for b in some) + ") m(a, b)"


@query(f"""WITH e AS (SELECT user_id, event_id, {STATE_OF} AS state FROM events WHERE user_id IS NOT NULL), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
 SELECT user_id, event_id, before, CASE WHEN before IN ('RESPONDING', 'FAILED') THEN 'terminal' WHEN EXISTS (SELECT 1 FROM {LEGAL} WHERE a = before AND b = state) THEN 'ok' ELSE 'illegal' END AS verdict FROM l WHERE before IS NOT NULL""")
def str6_moves(spark, sf):
    state = F.element_at(F.array(*map(F.lit, states.STATES)), (F.col("event_id") * 7 % 17 + 1).cast("int"))
    e = read(spark, sf, "events").filter("user_id IS NOT NULL").select("user_id", "event_id", state.alias("state"))
    return states.check_moves(e, "user_id", "event_id").filter("before IS NOT NULL").select("user_id", "event_id", "before", "verdict")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return ret9_hybrid_rrf(spark, sf)
