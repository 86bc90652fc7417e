"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by its own codebook; a pair of centroids is a cell (Babenko
and Lempitsky). A query ranks the centroids of each half and walks their pairs by summed distance with a heap, cell by
cell, until enough entries are gathered. Those are reranked by the exact inner product in double precision. As the
nearness is the inner product, the distance of a half is its negated inner product with the centroid, which adds up over
the halves.

Equal vectors are one entry that carries its least ids: of a vector's copies only the first k + 1 can be among a query's
k nearest, as ties go to the smaller id. Equal queries are searched once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose id is not null and whose vector has components, none null or non-finite, and not all zero."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad & some)
    return rows.withColumn("v", F.transform(v, lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0: equal vectors hash alike


def codebook(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the rows by Lloyd's algorithm, from rows spread evenly over the sample."""
    points = np.unique(sample, axis=0)
    k = min(k, len(points))
    centres = points[np.random.default_rng(7).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=k)
        for d in range(points.shape[1]):
            total = np.bincount(near, points[:, d], k)
            centres[:, d] = np.where(n > 0, total / np.maximum(n, 1), centres[:, d])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Non-empty cells by growing first[i] + second[j], until they hold `enough` entries or none is left (multi-sequence)."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y, n = first.tolist(), second.tolist(), counts.tolist()
    heap, out, held = [(x[a[0]] + y[b[0]], 0, 0)], [], 0
    reached = [-1] * len(a)  # the last column visited in each row
    while heap and held < enough:
        _, r, c = heapq.heappop(heap)
        reached[r] = c
        i, j = a[r], b[c]
        if n[i][j]:
            out.append((i, j))
            held += n[i][j]
        if c + 1 < len(b) and (r == 0 or reached[r - 1] > c):
            heapq.heappush(heap, (x[i] + y[b[c + 1]], r, c + 1))
        if r + 1 < len(a) and reached[r + 1] == c - 1:
            heapq.heappush(heap, (x[a[r + 1]] + y[j], r + 1, c))
    return out


def search(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    share: float = 0.4,
    sample: int = 20_000,
    most_centroids: int = 128,
    rows_a_piece: int = 4096,
    queries_a_block: int = 2048,
) -> DataFrame:
    """The k nearest of each query (ids divisible by `every`), among all rows but itself: query_id, rank, vec_id, score.

    The index holds every valid row; only the codebooks are fitted on a sample of at most `sample` distinct vectors,
    the first by hash. A query gathers share * entries, at any size; `share` buys recall (0.4 gives about 0.95 on vectors
    without clusters, where nothing but the quantised scores helps).

    * vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids;
    * vectors of another length than the most frequent one (of equally frequent ones: the least) take no part, as they
      have no inner product with it;
    * repeated rows (one id, one vector) are one row; one id with several vectors: each is a row of that id;
    * ties go to the smaller id, among all gathered entries; no valid rows: no result. Other columns are not read.

    A query goes to each first-half centroid once, with the list of second-half cells it wants. Cells under a centroid
    are split into pieces of about rows_a_piece entries and their queries into blocks of queries_a_block, so that a
    task's score matrix is bounded however hot a centroid is.
    """
    valid = valid_vectors(vectors, id_col, vector_col)
    lengths = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    id_type = vectors.schema[id_col].dataType
    if lengths is None:
        return valid.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    d = lengths["d"]
    half = d // 2
    valid = valid.filter(F.size("v") == d).distinct()
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    firsts = valid.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    entries = firsts.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stash(entries.withColumn("e", F.monotonically_increasing_id()), "entries")  # from here on a vector is its number
    n = entries.count()

    drawn = np.array([r["v"] for r in entries.select("v").orderBy(F.xxhash64("v", F.lit(1)), "v").limit(sample).collect()])
    size = min(most_centroids, max(2, n // 4))
    books = (codebook(drawn[:, :half], size) if half else np.zeros((1, 0)), codebook(drawn[:, half:], size))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, d)
            cells = [pa.array(nearest(x[:, :half], books[0]), pa.int32()), pa.array(nearest(x[:, half:], books[1]), pa.int32())]
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*cells, raw, b.column(1), b.column(2)], names=["i", "j", "x", "ids", "e"])

    ids_type = f"array<{id_type.simpleString()}>"
    index = stash(entries.select("v", "ids", "e").mapInArrow(assign, f"i int, j int, x binary, ids {ids_type}, e long"), "index")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # at most most_centroids squared rows
        counts[r["i"], r["j"]] = r["count"]
    enough = max(k + 1, math.ceil(share * n))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, x, e, cells = [], [], [], []
            for raw, who in zip(b.column(0), b.column(1), strict=True):
                q = np.frombuffer(raw.as_py())
                wanted: dict[int, list[int]] = {}
                for r, c in walk(-(books[0] @ q[:half]), -(books[1] @ q[half:]), counts, enough):
                    wanted.setdefault(r, []).append(c)
                for r, c in wanted.items():
                    i.append(r)
                    x.append(raw.as_py())
                    e.append(who.as_py())
                    cells.append(np.array(c, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(x, pa.binary()), pa.array(e, pa.int64()), pa.array(cells, pa.binary())], names=["i", "x", "e", "cells"])

    asked = stash(valid.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select("vec_id", "v").join(entries.select("v", "e"), "v"), "asked")
    parts = max(1, asked.count() // 128)  # a walk costs some 10 ms, so these are tasks of a second or two
    queries = _with_bytes(asked.dropDuplicates(["e"]).repartition(parts, "e"), d)
    wanted = stash(queries.mapInArrow(probe, "i int, x binary, e long, cells binary"), "probes")

    rows_in, asks_in = counts.sum(1), {r["i"]: r["count"] for r in wanted.groupBy("i").count().collect()}
    pieces = [max(1, math.ceil(c / rows_a_piece)) for c in rows_in.tolist()]
    blocks = [max(1, math.ceil(asks_in.get(i, 0) / queries_a_block)) for i in range(len(pieces))]
    facts = index.sparkSession.createDataFrame([(i, p, q) for i, (p, q) in enumerate(zip(pieces, blocks, strict=True))], "i int, pieces int, blocks int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(F.broadcast(facts), "i").withColumn("piece", F.pmod("e", "pieces").cast("int")).withColumn("block", each("blocks")).select("i", "piece", "block", "j", "x", "ids", "e")
    right = wanted.join(F.broadcast(facts), "i").withColumn("block", F.pmod("e", "blocks").cast("int")).withColumn("piece", each("pieces")).select("i", "piece", "block", "x", "e", "cells")

    def score(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame({"q": [], "ids": pd.Series([], dtype=object), "score": []})
        rows = rows.sort_values(["j", "e"], kind="stable")
        x, j = np.frombuffer(b"".join(rows["x"])).reshape(-1, d), rows["j"].to_numpy()
        starts = {int(c): (int(s), int(t)) for c, s, t in zip(*(lambda u, f, m: (u, f, f + m))(*np.unique(j, return_index=True, return_counts=True)), strict=True)}
        q, ids, got = [], [], []
        lists = rows["ids"].tolist()
        firsts_of, keep = np.array([i[0] for i in lists]), min(k + 1, len(x))
        for at in range(0, len(asks), 256):
            part = asks.iloc[at : at + 256]
            y = np.frombuffer(b"".join(part["x"])).reshape(-1, d)
            allowed: dict[int, list[int]] = {}
            for r, cells in enumerate(part["cells"]):
                for c in np.frombuffer(cells, "<i4").tolist():
                    allowed.setdefault(c, []).append(r)
            s = np.full((len(part), len(x)), -np.inf)
            for c, who in allowed.items():
                if c in starts:
                    lo, hi = starts[c]
                    s[who, lo:hi] = y[who] @ x[lo:hi].T
            # All within rounding of the (k + 1)-th score are scored exactly; of equal ones those of the least ids stay.
            cut = np.partition(s, len(x) - keep, axis=1)[:, len(x) - keep]
            for r, e in enumerate(part["e"].tolist()):
                low = cut[r] - 1e-9 * max(1.0, abs(cut[r])) if np.isfinite(cut[r]) else -np.inf
                cols = np.flatnonzero((s[r] >= low) & (s[r] > -np.inf))
                exact = (x[cols] * y[r]).sum(1)
                best = np.lexsort((firsts_of[cols], -exact))[:keep]
                q += [e] * len(best)
                ids += [lists[c] for c in cols[best]]
                got += exact[best].tolist()
        return pd.DataFrame({"q": q, "ids": pd.Series(ids, dtype=object), "score": got})

    keys = ["i", "piece", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, f"q long, ids {ids_type}, score double")
    near = found.select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = stash(near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).select("q", "score", "vec_id"), "nearest")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")).join(near, "q").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_bytes(vectors: DataFrame, d: int) -> DataFrame:
    """(x, e): the vector as little-endian doubles, and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], names=["x", "e"])

    return vectors.select("v", "e").mapInArrow(run, "x binary, e long")
