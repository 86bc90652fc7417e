"""Toxicity categories by a chain of linear classifiers.

The categories are predicted one after another. Each model is a logistic regression over hashed presence features (words
and word beginnings) and over the probabilities of the categories before it. In training these earlier probabilities are
out-of-fold predictions, so that a later model sees them as uncertain as they are on new documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, worker_cache

BITS = 20
PREFIXES = (3, 4, 5, 6)
EDGE = b".,;:!?|'\"()[]{}*#%$&-_"
CACHED_WORDS = 80_000
BLOCK = 512  # rows that are looked at together, so that little is held besides the features themselves


class WordFeatures(dict):
    """Feature numbers of a word as little-endian bytes: the word without its edges, its beginnings, and its right edge."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        w = word.strip(EDGE)
        chars = w.decode("utf-8")
        keys = [b"w" + w] + [b"p" + chars[:n].encode() for n in PREFIXES if n < len(chars)] if w else []
        keys += [b"e" + edge[:4]] if (edge := word[len(word.rstrip(EDGE)) :]) else []
        out = np.array([zlib.crc32(k) >> (32 - BITS) for k in keys], "<i4").tobytes()
        self[word] = out
        return out


def features(text: bytes, words: WordFeatures) -> np.ndarray:
    """Sorted numbers of the features present in a text (A-Z in lower case), over the whole of it."""
    return np.unique(np.frombuffer(b"".join([words[w] for w in set(text.lower().split())]), "<i4"))


def blocks(ptr: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows, BLOCK at most."""
    return ((at, min(at + BLOCK, len(ptr) - 1)) for at in range(0, len(ptr) - 1, BLOCK))


@dataclass
class Linear:
    weights: np.ndarray  # of the hashed features
    earlier: np.ndarray  # of the categories before
    bias: float

    def logits(self, ids: np.ndarray, ptr: np.ndarray, before: np.ndarray) -> np.ndarray:
        sums, run = np.zeros(len(ptr) - 1), 0.0
        for a, b in blocks(ptr):  # one running sum through all blocks: the sums do not depend on where these are cut
            total, at = np.cumsum(np.r_[run, self.weights[ids[ptr[a] : ptr[b]]]]), ptr[a : b + 1] - ptr[a]
            sums[a:b], run = total[at[1:]] - total[at[:-1]], total[-1]
        return sums + before @ self.earlier + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(ids: np.ndarray, ptr: np.ndarray, y: np.ndarray, least_z: float = 4.0, least_rows: int = 3) -> np.ndarray:
    """The features the two classes differ in, in order: two-proportion z score of at least least_z, on least_rows rows or more."""
    n1, n0 = max(y.sum(), 1.0), max(len(y) - y.sum(), 1.0)
    all_, one = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for a, b in blocks(ptr):
        part = ids[ptr[a] : ptr[b]]
        all_ += np.bincount(part, minlength=1 << BITS)
        one += np.bincount(part, np.repeat(y[a:b], np.diff(ptr[a : b + 1])), 1 << BITS)
    names = np.flatnonzero(all_ >= least_rows)
    all_, one = all_[names], one[names]
    p = all_ / max(len(y), 1)
    z = np.abs(one / n1 - (all_ - one) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return names[z >= least_z]


def cells(ids: np.ndarray, ptr: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in names) of each feature that is among names."""
    place, rows, cols = np.full(1 << BITS, -1, np.int32), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    place[names] = np.arange(len(names))
    for a, b in blocks(ptr):
        col = place[ids[ptr[a] : ptr[b]]]
        rows.append(np.repeat(np.arange(a, b), np.diff(ptr[a : b + 1]))[col >= 0])
        cols.append(col[col >= 0].astype(np.int64))
    return np.concatenate(rows), np.concatenate(cols)


def fit_linear(ids: np.ndarray, ptr: np.ndarray, before: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.3, l2: float = 1e-5) -> Linear:
    """Logistic regression on the telling features by full-batch AdaGrad; the other weights are 0."""
    m = Linear(np.zeros(1 << BITS), np.zeros(before.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    names = telling(ids, ptr, y)
    rows, cols = cells(ids, ptr, names)
    w, gw, ge, gb = np.zeros(len(names)), np.full(len(names), 1e-8), np.full(before.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(rows, w[cols], len(y)) + before @ m.earlier + m.bias
        g = (sigmoid(z) - y) / max(len(y), 1)
        dw = np.bincount(cols, g[rows], len(names)) + l2 * w
        de, db = before.T @ g + l2 * m.earlier, g.sum()
        gw, ge, gb = gw + dw * dw, ge + de * de, gb + db * db
        w -= rate * dw / np.sqrt(gw)
        m.earlier -= rate * de / np.sqrt(ge)
        m.bias -= rate * db / np.sqrt(gb)
    m.weights[names] = w
    return m


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        before = np.zeros((len(ptr) - 1, 0))
        for m in self.models:
            before = np.c_[before, sigmoid(m.logits(ids, ptr, before))]
        return before


def _take(ids: np.ndarray, ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [ids[ptr[r] : ptr[r + 1]] for r in rows]
    return (np.concatenate(parts) if parts else ids[:0]), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)].astype(np.int64)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle between the two out-of-fold probabilities at which the F1 score is highest; 0.5 without positive rows."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # no cut between equal probabilities
    at = int(np.argmax(f1))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def fit_chain(ids: np.ndarray, ptr: np.ndarray, labels: np.ndarray, categories: tuple[str, ...], folds: int = 3) -> Chain:
    """Fit the chain on rows in a stable order; row r belongs to fold r mod folds."""
    n = len(labels)
    fold, before, models, cuts = np.arange(n) % folds, np.zeros((n, 0)), [], []
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        models.append(fit_linear(ids, ptr, before, y))
        out = np.full(n, y.mean() if n else 0.0)
        for f in range(folds):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(train) and len(test):
                m = fit_linear(*_take(ids, ptr, train), before[train], y[train])
                out[test] = sigmoid(m.logits(*_take(ids, ptr, test), before[test]))
        cuts.append(best_threshold(out, y))
        before = np.c_[before, out]
    return Chain(categories, models, cuts)


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids): the features of each text as binary."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("toxicity words", WordFeatures)
        for b in batches:
            ids = [features(t.as_py() or b"", words).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", most_rows: int = 8000) -> Chain:
    """Fit the chain on at most most_rows labelled documents, those with the least hash of their id.

    categories: name -> SQL expression over labels that is true where a row has the category; their order is the chain's.
    Rows whose id or any category is null are left out; of repeated label rows a category holds if one has it, and of
    documents that share an id the one with the least text is trained on, so that most_rows bounds what the driver gets.
    Ties in the hash go to the smaller id. Without labelled rows all probabilities are near 0 and nothing is flagged.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), *(F.expr(e).cast("int").alias(f"c{i}") for i, e in enumerate(categories.values()))).dropna()
    own = own.groupBy("doc_id").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # most_rows bounds it
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"))
    marks = {r["doc_id"]: [r[f"c{i}"] for i in range(len(categories))] for r in sample.collect()}
    got = feature_rows(found, "doc_id", "text").toArrow()  # not as rows, which the driver would hold twice
    rows = sorted(zip(got["doc_id"].to_pylist(), (x.as_buffer() for x in got["ids"]), strict=True), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
    parts = [np.frombuffer(ids, "<i4") for _, ids in rows]
    ptr = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)].astype(np.int64)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    y = np.array([marks[doc_id] for doc_id, _ in rows], float).reshape(len(rows), len(categories))
    del got, rows, parts
    give_back()
    if not len(y):
        flat = [Linear(np.zeros(1 << BITS), np.zeros(i), -9.0) for i in range(len(categories))]
        return Chain(tuple(categories), flat, [0.5] * len(categories))
    chain = fit_chain(ids, ptr, y, tuple(categories))
    del ids
    give_back()
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row, without a shuffle: id, the columns in keep, and p_<category> and is_<category> of each.

    Whole texts count, however long. Null text: no features, so the probabilities of the biases. Repeated rows and null
    ids: scored like any other; a probability equal to the threshold is flagged. Empty input: no rows. Columns that are
    not in keep, whatever their names, are not read.
    """
    names = [f"p_{c}" for c in chain.categories]
    schema = docs.select(F.col(id_col), *keep).schema
    for c in names:
        schema = schema.add(c, "double")
    for c in chain.categories:
        schema = schema.add(f"is_{c}", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("toxicity words", WordFeatures)
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            rows = [features(t.as_py() or b"", words) for t in b.column(at_text).cast(pa.binary())]
            ptr = np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)].astype(np.int64)
            p = chain.probabilities(np.concatenate([*rows, np.zeros(0, np.int32)]), ptr)
            cols = [pa.array(p[:, c], pa.float64()) for c in range(p.shape[1])] + [pa.array(p[:, c] >= t, pa.bool_()) for c, t in enumerate(chain.thresholds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(keep)], *cols], names=schema.names)

    at_text = 1 + (keep.index(text_col) if text_col in keep else len(keep))
    extra = [] if text_col in keep else [F.col(text_col).alias("_text_to_score")]
    return docs.select(F.col(id_col), *keep, *extra).mapInArrow(run, schema)
