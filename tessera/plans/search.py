"""Queries of the search entry: every strategy with its filters and fallbacks, and the inverted file with its recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import dispatch, retrieval
from tessera.plans.built import _engine
from tessera.plans.catalog import CHUNKS, WORDS, query
from tessera.sources.tables import LINES, read

SCORED = f"""w AS (SELECT chunk_id, {WORDS.format("content")} AS ws FROM chunks), st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
 p AS (SELECT chunk_id, term, dl, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY ALL), t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 q AS (SELECT name, term, count(*) AS qtf FROM (SELECT 'asked' AS name, unnest({WORDS.format("text")}) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark) UNION ALL SELECT 'pattern', unnest(['licensed', 'under'])) GROUP BY ALL),
 s AS (SELECT name, chunk_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN t USING (term) JOIN p USING (term) CROSS JOIN st GROUP BY ALL),
 bm AS (SELECT name, chunk_id, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 50),
 e AS (SELECT vec_id * 4294967296 AS chunk_id, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT chunk_id, round(list_inner_product(x, (SELECT x FROM e WHERE chunk_id = 0)), 6) AS score FROM e),
 dn AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM d WHERE score > 0 QUALIFY rank <= 20),
 hy AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT chunk_id, round(sum(1.0 / (rank + 60)), 6) AS score FROM (SELECT chunk_id, rank FROM bm WHERE name = 'asked' AND rank <= 20 UNION ALL SELECT chunk_id, rank FROM dn) GROUP BY chunk_id) QUALIFY rank <= 40),
 x AS (SELECT chunk_id, least((length(content) - length(replace(lower(content), 'license', ''))) // 7, 10) / 10.0 AS score, instr(lower(content), 'license') AS place FROM chunks WHERE contains(lower(content), 'license')),
 hits AS (SELECT 'bm25' AS strategy, chunk_id, rank FROM bm JOIN chunks USING (chunk_id) WHERE name = 'asked' AND rank <= 20 AND lang = 'en'
  UNION ALL SELECT 'dense', chunk_id, rank FROM dn UNION ALL SELECT 'hybrid', chunk_id, rank FROM hy JOIN chunks USING (chunk_id) WHERE contains(source, 'src1')
  UNION ALL SELECT 'exact', chunk_id, rank FROM (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, place, chunk_id) AS rank FROM x QUALIFY rank <= 20) JOIN chunks USING (chunk_id) WHERE lang IN ('en')
  UNION ALL SELECT 'metadata', chunk_id, row_number() OVER (ORDER BY chunk_id) FROM chunks WHERE lang = 'de' UNION ALL SELECT 'relation', chunk_id, row_number() OVER (ORDER BY chunk_id) FROM chunks WHERE lang = 'fr'
  UNION ALL SELECT 'table', chunk_id, rank FROM (SELECT chunk_id, row_number() OVER (ORDER BY round(1.0 / (rank + 60), 6) DESC, chunk_id) AS rank FROM bm WHERE name = 'pattern') JOIN chunks USING (chunk_id) WHERE contains(source, 'src1'))"""


@query(f"WITH {CHUNKS}, {SCORED} SELECT strategy, chunk_id, CAST(nth AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY rank, chunk_id) AS nth FROM hits) WHERE nth <= 20")
def ret11_strategies(spark, sf):
    """All seven strategies. bm25's and dense's filters pass nothing with their doc_name and fall back to the others, or none; no table row has the pattern, so fused hits of its document stand in."""
    e = read(spark, sf, "embeddings").select((F.col("vec_id") * LINES).alias("chunk_id"), "embedding")
    engine = _engine(spark, sf)
    engine = dispatch.Engine(engine.chunks.withColumn("doc_name", F.col("source")), e, engine.cells)
    asked = read(spark, sf, "benchmark").agg(F.min_by("text", "item_id")).first()[0]
    vector = tuple(e.filter("chunk_id = 0").first()["embedding"])
    requests = [
        dispatch.Request(asked, "bm25", 20, {"lang": "en", "doc_name": "nowhere"}), dispatch.Request(asked, "dense", 20, {"doc_name": "nowhere"}, vector), dispatch.Request(asked, "hybrid", 20, {"doc_name": "SRC1"}, vector),
        dispatch.Request("license", "exact", 20, {"lang": "en"}), dispatch.Request("", "metadata", 20, {"lang": "de"}), dispatch.Request("", "relation", 20, {"lang": "fr"}),
        dispatch.Request("licensed under", "table", 20, {"table_name": "nations of 2", "doc_name": "src1"}),
    ]
    found = [hits.select(F.lit(r.strategy).alias("strategy"), "chunk_id", "rank") for r, hits in zip(requests, engine.search_all(requests), strict=True)]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("""WITH kn AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
 SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM kn QUALIFY rank <= 10""")
def ret6_ivf_whole(spark, sf):
    """The inverted file looked into whole: with as many probes as lists it is exact."""
    e = read(spark, sf, "embeddings")
    return dispatch.ivf_search(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, lists=16, probes=16).select("query_id", "vec_id", "score", "rank")


def ivf_recall(spark, sf: str, lists: int, probes: int, top_k: int = 10) -> float:
    """The part of the exact nearest rows that the inverted file finds, over every hundredth vector."""
    e = read(spark, sf, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = retrieval.knn(e, asked, top_k, least=-2.0).select("query_id", "vec_id")
    found = dispatch.ivf_search(e, asked, top_k, lists=lists, probes=probes).select("query_id", "vec_id")
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / exact.count()


