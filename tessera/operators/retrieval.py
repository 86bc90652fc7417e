"""Retrieval channels and their fusion: BM25, exact kNN in blocks, reciprocal rank fusion, context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import each, tokens
from tessera.sources.rounds import settle

K1, B, RRF_K = 1.5, 0.75, 60


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl): term frequencies and document lengths. One shuffle, combined in each task."""
    words = docs.select(key, tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    return each(words, F.col("w"), "term", key, "dl").groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings, and (term, df, idf, avgdl) with idf = ln((N - df + 0.5) / (df + 0.5) + 1). Texts without words count in N.

    Frequencies are counted from each text's distinct words, so no postings are shuffled for them. Only texts that share key
    and length, whose postings are one, go by postings.
    """
    words = docs.select(key, tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    sizes = settle(words.select(key, "dl"))
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = total["n"], total["avgdl"] or 1.0
    again = sizes.groupBy(F.col(key).alias("_key"), F.col("dl").alias("_dl")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    if again.isEmpty():
        once = each(words, F.array_distinct("w"), "term")
    else:
        same = words[key].eqNullSafe(again["_key"]) & words["dl"].eqNullSafe(again["_dl"])
        many = each(words.join(again, same, "left_semi"), F.col("w"), "term", key, "dl").distinct()
        once = each(words.join(again, same, "left_anti"), F.array_distinct("w"), "term").unionByName(many.select("term"))
    post, terms = postings(docs, key, text), once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return post, terms.select("term", "df", idf.alias("idf"), F.lit(float(avgdl)).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries(query_id, query)."""
    return each(queries, tokens(F.col("query")), "term", "query_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_search(docs: DataFrame, queries: DataFrame, top_k: int, key: str = "doc_id", text: str = "text", most_sent: int = 1_000_000, block: int = 1024) -> DataFrame:
    """(query_id, key, score, rank) of the top_k documents of each query(query_id, query).

    A term that a query repeats counts as often. Scores are rounded to 6 digits; ties go to the smaller key.

    Up to most_sent query terms go to all tasks. Texts are then tokenised once, into the query terms they hold, which are
    written; document frequencies come from there. A task scores blocks of `block` documents against blocks of as many
    queries, a term at a time, and passes on what may be among the top_k of all, so neither postings nor pairs of queries
    and documents are shuffled, and memory is bounded by the block. More query terms join the postings instead, of which
    only those of a query term are shuffled.
    """
    asked = query_terms(queries)
    if asked.count() > most_sent:
        return top(_joined_scores(docs, asked, key, text).filter("score > 0"), top_k, "query_id", key)
    pdf = asked.toPandas()
    names = {t: i for i, t in enumerate(sorted(set(pdf["term"])))}
    ids = sorted(set(pdf["query_id"]))
    of = {q: i for i, q in enumerate(ids)}
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(names)
    key_kind, id_kind = docs.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    words = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("w"))
    held = settle(words.mapInArrow(_held_terms(known), f"`{key}` {key_kind}, dl int, term array<int>, tf array<int>"))

    total = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    idf = np.zeros(len(names))
    for term, df in held.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row a query term
        idf[term] = np.log((total["n"] - df + 0.5) / (df + 0.5) + 1)
    rows = np.array([(of[q] // block, names[t], of[q], n) for q, t, n in zip(pdf["query_id"], pdf["term"], pdf["qtf"], strict=True)], np.int64).reshape(-1, 4)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    sent = spark.sparkContext.broadcast((ids, idf, rows))
    id_type = pa.int64() if id_kind == "bigint" else pa.int32() if id_kind == "int" else pa.string()
    scored = held.mapInArrow(_scored(sent, total["avgdl"] or 1.0, top_k, block, id_type), f"query_id {id_kind}, `{key}` {key_kind}, score double")
    return top(scored, top_k, "query_id", key)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where fewer partitions hold them, as one small file does; larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _pieces(rows: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of rows with `most` elements of a column's lists each, or a single row."""
    ends, at = np.cumsum(pc.fill_null(pc.list_value_length(rows.column(column)), 0).to_numpy()), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield rows.slice(at, to - at)
        at = to


def _held_terms(known, most_words: int = 200_000):
    """Of each row (key, w) the number of words, and the known terms among them with their frequencies.

    A batch of many rows is read in slices of most_words words, which bounds what the worker holds besides it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = known.value
        for b in (p for whole in batches for p in _pieces(whole, 1, most_words)):
            lists = b.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten().dictionary_encode()
            place = np.array([names.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)
            term, doc = place[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64), np.repeat(np.arange(len(n)), n)
            cell, tf = np.unique(doc[term >= 0] * max(len(names), 1) + term[term >= 0], return_counts=True)
            limits = pa.array(np.searchsorted(cell, np.arange(len(n) + 1) * max(len(names), 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(limits, pa.array(x.astype(np.int32))) for x in (cell % max(len(names), 1), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), *lists], names=[b.schema.names[0], "dl", "term", "tf"])

    return run


def _best(scores: np.ndarray, k: int, floor: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores above least, of equal ones the earlier columns, if not below the row's floor."""
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
    r, c = np.nonzero((scores > least) & (scores >= floor[:, None]))
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def _scored(sent, avgdl: float, top_k: int, block: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf, asked = sent.value
        chunks = np.searchsorted(asked[:, 0], np.arange(-(-len(ids) // block) + 1))
        kept = np.zeros((len(ids), top_k))  # each query's best scores of the task so far, the least of them first
        for b in (whole.slice(at, block) for whole in batches for at in range(0, whole.num_rows, block)):
            b = b.take(pc.sort_indices(b.column(0)))
            term, tf, n = b.column("term").flatten().to_numpy(), b.column("tf").flatten().to_numpy(), b.column("dl").to_numpy()
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("term")).to_numpy())
            order = np.argsort(term, kind="stable")
            term, tf, doc = term[order], tf[order], doc[order]
            gain = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[doc] / avgdl))
            for chunk in range(len(chunks) - 1):
                own = asked[chunks[chunk] : chunks[chunk + 1]]
                base, size = chunk * block, min(block, len(ids) - chunk * block)
                scores = np.zeros((size, b.num_rows))
                terms = np.unique(own[:, 1])
                spans = zip(*(np.searchsorted(x, terms, side) for x in (own[:, 1], term) for side in ("left", "right")), strict=True)
                for q0, q1, d0, d1 in spans:
                    if d1 > d0:
                        scores[np.ix_(own[q0:q1, 2] - base, doc[d0:d1])] += own[q0:q1, 3, None] * gain[d0:d1]
                scores = scores.round(6)
                best = kept[base : base + size]
                r, c = _best(scores, top_k, best[:, 0])
                if len(r):
                    more = np.zeros((size, top_k))
                    more[r, np.arange(len(r)) - np.searchsorted(r, r)] = scores[r, c]
                    kept[base : base + size] = np.sort(np.concatenate((best, more), axis=1), axis=1)[:, -top_k:]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[base + i] for i in r.tolist()], id_type), b.column(0).take(pa.array(c)), pa.array(scores[r, c])], names=["query_id", b.schema.names[0], "score"])

    return run


def _joined_scores(docs: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, score) by joins, for query sets of any size."""
    wanted = asked.select("term").distinct()
    words = docs.select(key, tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    post = each(words, F.col("w"), "term", key, "dl").join(wanted, "term", "left_semi").groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    total = words.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total), F.lit(True))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = asked.join(df.select("term", idf.alias("idf"), F.coalesce("avgdl", F.lit(1.0)).alias("avgdl")), "term")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return post.join(weighted, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("qtf") * gain), 6).alias("score"))


def top(hits: DataFrame, k: int, by: str, key: str) -> DataFrame:
    """Ranks within `by` by falling score, then key; the limit is pushed below the shuffle by Spark."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def _nearest(top_k: int, least: float):
    """(query_id, vec_id, score) of a block of queries (ids, q: one row) and a part of the vectors (vec_id, embedding): each query's top_k above least."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, q = np.array(right["ids"].iloc[0]), np.array(right["q"].iloc[0], float)
        q, x, names = q.reshape(len(ids), -1), np.array(left["embedding"].tolist(), float), left["vec_id"].to_numpy()
        order = np.argsort(names, kind="stable")
        x, names, out = x[order], names[order], []
        for at in range(0, len(ids), 256):
            s = (q[at : at + 256] @ x.T).round(6)
            r, c = _best(s, top_k, np.full(len(s), -np.inf), least)
            out.append(pd.DataFrame({"query_id": ids[at : at + 256][r], "vec_id": names[c], "score": s[r, c]}))
        return pd.concat(out)

    return run


def knn(vectors: DataFrame, queries: DataFrame, top_k: int, least: float = 0.0, block: int = 1024, piece: int = 20_000) -> DataFrame:
    """(query_id, vec_id, score, rank): exact nearest rows by inner product; scores to 6 digits, ties to the smaller vec_id.

    queries(query_id, embedding) of any number are put into blocks of `block`, a row each, by a range of their ids; every
    block meets every part of the vectors, some `piece` rows at most, in one task, which keeps its top_k a query before the
    shuffle. Nothing is collected: the vectors are read once and repeated for the blocks, the query set being a stated one.
    """
    n = max(1, -(-queries.count() // block))
    if n == 1:
        blocks = queries.select(F.lit(0).alias("block"), "query_id", "embedding")
    else:
        blocks = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("block"), "query_id", "embedding")
    packed = blocks.groupBy("block").agg(F.collect_list("query_id").alias("ids"), F.flatten(F.collect_list(F.col("embedding").cast("array<double>"))).alias("q"))
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // piece))
    held = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    left = held.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_nearest(top_k, least), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    return top(found, top_k, "query_id", "vec_id")


def rrf(channels: list[DataFrame], top_k: int, by: str = "query_id", key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked channels(by, key, rank); ties go to the smaller key. One union, one grouped sum."""
    both = None
    for c in channels:
        part = c.select(by, key, (1.0 / (F.col("rank") + k)).alias("part"))
        both = part if both is None else both.unionByName(part)
    return top(both.groupBy(by, key).agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("channels")), top_k, by, key)


def pack_context(hits: DataFrame, budget: int = 3000, most: int = 1000, by: str = "query_id", order: str = "rank", text: str = "content") -> DataFrame:
    """Hits in order whose texts (cut to `most` characters) fit a running budget; stops at the first that does not."""
    size = F.least(F.length(text), F.lit(most))
    running = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", running).filter(F.col("used") <= budget)
