"""One entry for all retrieval strategies: filters with fallbacks, channels that may be replaced, tables with a fallback, a facade."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import filters, retrieval, shapes, tables
from tessera.operators.names import resolve_tables
from tessera.sources.rounds import settle

STRATEGIES = ("bm25", "dense", "hybrid", "exact", "metadata", "relation", "table")
FUSED, FUSED_LEAST = 3, 50  # candidates of the table strategy's fallback: three times what is asked for, 50 at least


@dataclass(frozen=True)
class Request:
    """What to search for. vector is the encoded query, which the dense channel needs; filters maps a field to a value."""

    query: str = ""
    strategy: str = "hybrid"
    top_k: int = 10
    filters: dict[str, object] = field(default_factory=dict)
    vector: tuple[float, ...] | None = None
    exact_mode: str = "contains"
    bm25_k: int = 20
    vector_k: int = 20
    request_id: str = ""


Channel = Callable[["Engine", Request], DataFrame]


class Engine:
    """Chunks with their vectors and tables, and a channel of each strategy; any channel may be replaced by one's own.

    A channel returns (chunk_id, score, rank). chunks(chunk_id, content, ...), vectors(chunk_id, embedding),
    cells as tables.parse returns them, with table_id being the table's name.
    """

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, cells: DataFrame | None = None, substring_fields: tuple[str, ...] = filters.SUBSTRING_FIELDS, **channels: Channel):
        self.chunks, self.vectors, self.cells, self.substring_fields = chunks, vectors, cells, substring_fields
        self.channels: dict[str, Channel] = {"bm25": bm25, "dense": dense, "hybrid": hybrid, "exact": exact, "metadata": metadata, "relation": metadata, "table": table} | channels
        self.texts: dict[str, tuple[int, DataFrame]] = {}  # found for a text or a vector beforehand: how many at most, and these
        self.nearest: dict[tuple[float, ...], tuple[int, DataFrame]] = {}

    def allowed(self, request: Request) -> DataFrame | None:
        """Chunks that pass the filters: all of them, else without that on doc_name, else None (no filter), as a filter that nothing passes should not leave a question without hits."""
        for used in (request.filters, {k: v for k, v in request.filters.items() if k != "doc_name"}):
            if not used:
                continue
            rows = filters.metadata_filter(self.chunks, {k: ("eq", v) for k, v in used.items()}, "chunk_id", substring_fields=self.substring_fields)
            if not rows.isEmpty():
                return rows.select("chunk_id")
        return None

    def search_all(self, requests: list[Request]) -> list[DataFrame]:
        """What search returns for each request; what their texts and vectors find is looked up in one pass over the chunks and one over the vectors."""
        texts: dict[str, int] = {}
        vectors: dict[tuple[float, ...], int] = {}
        for r in requests:
            k, channel = max(FUSED * r.top_k, FUSED_LEAST), self.channels.get(r.strategy)
            text, n, m = {bm25: (r.query, r.top_k, 0), dense: ("", 0, r.top_k), hybrid: (r.query, r.bm25_k, r.vector_k), table: (_pattern(r), k, k)}.get(channel, ("", 0, 0))
            if text and n:
                texts[text] = max(n, texts.get(text, 0))
            if m and r.vector is not None and self.vectors is not None and (channel is not table or text):
                vectors[r.vector] = max(m, vectors.get(r.vector, 0))
        spark = self.chunks.sparkSession
        if texts:
            k, asked = max(texts.values()), spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
            found = settle(retrieval.bm25_search(self.chunks, asked, k, "chunk_id", "content").select("query_id", "chunk_id", "score", "rank"))
            self.texts |= {t: (k, found.filter(F.col("query_id") == i).drop("query_id")) for i, t in enumerate(texts)}
        if vectors:
            k, asked = max(vectors.values()), spark.createDataFrame([(i, list(v)) for i, v in enumerate(vectors)], "query_id int, embedding array<double>")
            found = settle(retrieval.knn(self.vectors.withColumnRenamed("chunk_id", "vec_id"), asked, k).select("query_id", F.col("vec_id").alias("chunk_id"), "score", "rank"))
            self.nearest |= {v: (k, found.filter(F.col("query_id") == i).drop("query_id")) for i, v in enumerate(vectors)}
        return [self.search(r) for r in requests]

    def search(self, request: Request) -> DataFrame:
        """(chunk_id, score, rank, matched_by, trace) of the strategy's channel, after its filters, best first."""
        if request.strategy not in self.channels:
            raise ValueError(f"unknown strategy {request.strategy!r}")
        most = max(request.top_k, request.bm25_k + request.vector_k, FUSED * request.top_k, FUSED_LEAST)
        hits = self.channels[request.strategy](self, request).filter(F.col("rank") <= most)
        if request.strategy not in ("metadata", "relation", "table") and (kept := self.allowed(request)) is not None:
            hits = _among(hits, kept)
        told = {"request_id": F.lit(request.request_id), "strategy": F.lit(request.strategy)}
        again = F.row_number().over(Window.orderBy("rank", "chunk_id"))  # at most top_k or some dozen rows
        hits = hits.withColumn("rank", again).filter(F.col("rank") <= request.top_k)
        return hits.select("chunk_id", "score", "rank", F.array(F.lit(request.strategy)).alias("matched_by"), shapes.trace(told, {"score": F.round("score", 6)}).alias("trace"))

    def chunk(self, chunk_id: object) -> DataFrame:
        return self.chunks.filter(F.col("chunk_id") == F.lit(chunk_id))

    def document(self, doc_id: object) -> DataFrame:
        return self.chunks.filter(F.col("doc_id") == F.lit(doc_id))

    def listed(self, limit: int = 50, offset: int = 0, **wanted: object) -> DataFrame:
        """A page of the chunks whose fields have the wanted values."""
        rows = filters.metadata_filter(self.chunks, {k: ("eq", v) for k, v in wanted.items()}, "chunk_id", substring_fields=self.substring_fields)
        return shapes.page(rows, "chunk_id", limit, offset)


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a whole table: the limit runs in each task first, so one task ranks k rows."""
    few = rows.orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("chunk_id", "score", "rank")


def _among(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """The hits, some dozen rows, whose chunks are among rows; these are cut to the hits first, so that no ids of a whole corpus are shuffled."""
    hits = settle(hits)
    few = rows.select("chunk_id").join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_semi")
    return hits.join(few, "chunk_id", "left_semi")


def _pattern(request: Request) -> str:
    return str(request.filters.get("pattern", request.query))


def bm25(engine: Engine, request: Request, k: int | None = None) -> DataFrame:
    most, found = engine.texts.get(request.query, (0, None))
    if (k or request.top_k) <= most:
        return found.filter(F.col("rank") <= (k or request.top_k))
    asked = engine.chunks.sparkSession.createDataFrame([(0, request.query)], "query_id int, query string")
    return retrieval.bm25_search(engine.chunks, asked, k or request.top_k, "chunk_id", "content").select("chunk_id", "score", "rank")


def dense(engine: Engine, request: Request, k: int | None = None) -> DataFrame:
    if engine.vectors is None or request.vector is None:
        raise ValueError("the dense channel needs vectors and an encoded query")
    most, found = engine.nearest.get(request.vector, (0, None))
    if (k or request.top_k) <= most:
        return found.filter(F.col("rank") <= (k or request.top_k))
    asked = engine.chunks.sparkSession.createDataFrame([(0, list(request.vector))], "query_id int, embedding array<double>")
    found = retrieval.knn(engine.vectors.withColumnRenamed("chunk_id", "vec_id"), asked, k or request.top_k)
    return found.select(F.col("vec_id").alias("chunk_id"), "score", "rank")


def hybrid(engine: Engine, request: Request) -> DataFrame:
    return fused(engine, request, request.bm25_k, request.vector_k, request.bm25_k + request.vector_k)


def fused(engine: Engine, request: Request, bm25_k: int, vector_k: int, k: int) -> DataFrame:
    """Reciprocal ranks of both channels, or of the lexical one alone where there is no vector; filters come after the channels are cut."""
    parts = [bm25(engine, request, bm25_k)]
    if engine.vectors is not None and request.vector is not None:
        parts.append(dense(engine, request, vector_k))
    one = [p.withColumn("query_id", F.lit(0)) for p in parts]
    return retrieval.rrf(one, k, "query_id", "chunk_id").select("chunk_id", "score", "rank")


def exact(engine: Engine, request: Request) -> DataFrame:
    found = filters.exact_match(engine.chunks, request.query, request.exact_mode)
    return _ranked(found, request.top_k, F.desc("score"), F.col("match_pos"), F.col("chunk_id"))


def metadata(engine: Engine, request: Request) -> DataFrame:
    rows = filters.metadata_filter(engine.chunks, {k: ("eq", v) for k, v in request.filters.items()}, "chunk_id", substring_fields=engine.substring_fields)
    return _ranked(rows.withColumn("score", F.lit(1.0)), request.top_k, F.col("chunk_id"))


def table(engine: Engine, request: Request) -> DataFrame:
    """Rows of the named table that have the pattern (of all tables, if the name resolves to none), then fused hits on the pattern that are not among them; doc_name restricts the fused hits."""
    if engine.cells is None:
        raise ValueError("the table strategy needs parsed tables")
    told, pattern = str(request.filters.get("table_name", "")), _pattern(request)
    rows = engine.cells
    if told:
        spark = rows.sparkSession
        asked = spark.createDataFrame([(0, told)], "ask_id int, text string")
        names = rows.select(F.col("table_id").cast("string").alias("name")).distinct()
        best = resolve_tables(asked, names).select(F.col("name").alias("_name"))
        if not best.isEmpty():
            rows = rows.join(F.broadcast(best), F.col("table_id").cast("string") == F.col("_name"), "left_semi")  # one row
    else:
        rows = rows.limit(0)
    found = tables.find_rows(rows, pattern, request.filters.get("col_name")).groupBy("chunk_id").agg(F.min(F.struct("table_id", "row_index")).alias("place"))
    first = found.select("chunk_id", F.lit(1.0).alias("score"), F.lit(0).alias("part"), F.col("place"))
    k = max(FUSED * request.top_k, FUSED_LEAST)
    more = fused(engine, Request(pattern, vector=request.vector), k, k, k) if pattern else first.limit(0).select("chunk_id", "score", F.lit(0).alias("rank"))
    if request.filters.get("doc_name"):
        kept = filters.metadata_filter(engine.chunks, {"doc_name": ("eq", request.filters["doc_name"])}, "chunk_id", substring_fields=engine.substring_fields)
        if not kept.isEmpty():
            more = _among(more, kept)
    rest = more.join(first.select("chunk_id"), "chunk_id", "left_anti")
    top = first.orderBy("place").limit(request.top_k).select("chunk_id", "score", F.lit(0).alias("part"), F.row_number().over(Window.orderBy("place")).alias("at"))
    both = top.unionByName(rest.select("chunk_id", "score", F.lit(1).alias("part"), F.col("rank").alias("at")))
    return _ranked(both, request.top_k, F.col("part"), F.col("at"), F.col("chunk_id"))


def ivf_search(vectors: DataFrame, queries: DataFrame, top_k: int, lists: int = 100, probes: int = 10, sample: int = 20_000, seed: int = 7, block: int = 4096, piece: int = 20_000) -> DataFrame:
    """(query_id, vec_id, score, rank) from an inverted file: vectors are dealt to the nearest of `lists` centroids by k-means, and a query looks into the lists of its `probes` nearest ones.

    The centroids are fitted on at most `sample` vectors, those with the least hash; all vectors are in the index. Recall
    is bought with probes; probes = lists is exact. Some `block` queries of a list meet some `piece` of its vectors in one task,
    as one product of matrices, and only their top_k go on, so a list may be of any size; pairs are not rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = lambda rows: rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    few = features(vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample))
    k = max(2, min(lists, few.count()))
    model = KMeans(k=k, seed=seed, maxIter=10).setPredictionCol("list").fit(few)
    placed = model.transform(features(vectors.select("vec_id", "embedding"))).select("vec_id", "embedding", "list")
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
    away = F.aggregate(F.zip_with("q", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).join(F.broadcast(centres), F.lit(True))  # `lists` rows
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(away, "list"))
    asked = asked.withColumn("near", near).filter(F.col("near") <= probes).select("query_id", "q", "list")
    sizes = dict(placed.groupBy("list").count().collect())  # `lists` rows
    least = -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // k)
    parts = F.get(F.array(*(F.lit(max(least, -(-sizes.get(i, 0) // piece))) for i in range(k))), F.col("list"))
    blocks = max(1, -(-queries.count() // block))
    left = placed.select("list", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    packed = asked.groupBy("list", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("query_id").alias("ids"), F.flatten(F.collect_list("q")).alias("q"))
    right = packed.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    keys = ("list", "block", "part")
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(retrieval._nearest(top_k, -math.inf), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    return retrieval.top(scored, top_k, "query_id", "vec_id")
