"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A token falls into one of `side` x `side` slots: the most frequent training tokens have one each, and all others share
the `side` slots of the class of rare tokens, by the hash of the word. The model gives

    P(token | context) = P(class | context) * P(slot | class, context) * P(token | slot),

where the last factor is 1 for a frequent token and a smoothed unigram over all rare tokens of the slot. Both softmaxes
have `side` outcomes, and their logits are sums of hashed weights over n-gram and skip features of the three words
before: w1, w1 w2, w2 alone, w3 alone; without any weight they are the unigram model. Features are hashes of whole words, whether frequent or not. All factors are
normalised, so the scores of two models of one vocabulary can be compared.

What the model holds grows with the corpus: side with the fourth root of the counted types (slots with their square
root), the rows of weights with their square root, and the unigram counts are those of all types: the most frequent (a
bounded number) are sent to the tasks, the others are joined by their hash.

Training is one pass of AdaGrad over every training document, in rounds over disjoint parts of them. In a round all tasks
start from the same weights; a row of weights is then averaged over the tasks by how often each has met it (iterative
parameter mixing), and the next round starts there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scoped, stash, worker_cache

END_KEY = 0  # hash of the end token; no word has it, see token_key
BEGIN_KEY = 1 << 62  # stands for the three places before a text
BACK = 3  # words of context
CHUNK = 8192
RATE = 0.15
BLOCK = 1024  # rows of weights that travel together
PIECE = 4 << 20  # bytes of text that are coded together
ROUNDS = (1, 4, 16)  # ends of the rounds, in sixteenths of the documents
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def token_key(word: bytes) -> int:
    """Signed XXH64 of a word; a word that hashes to the end token's 0 takes 1."""
    x = xxhash.xxh64_intdigest(word) or 1
    return x - (1 << 64) if x >> 63 else x


def held_out(id_col: str):
    """The remainder 1 of crc32(id as text) mod 5; a null id counts as the empty text (in training)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def up(x: float, least: int) -> int:
    """The power of two at or above x, and at or above least."""
    return max(least, 1 << max(0, int(np.ceil(np.log2(max(x, 1))))))


@dataclass(frozen=True)
class Shape:
    """Sizes of the model, from the number of counted types. word rows carry the weights of w1, w2 and w3 alone side by side, for the class."""

    side: int
    word_rows: int
    pair_rows: int
    member_rows: int

    @classmethod
    def of(cls, types: int) -> Shape:
        root = float(max(types, 1)) ** 0.5
        return cls(up(0.6 * root**0.5, 32), up(8 * root, 1 << 14), up(8 * root, 1 << 14), up(16 * root, 1 << 15))


def rare_slot(key, side: int):
    """Slot of a token without one of its own, from the hash's higher bits. Columns and arrays alike."""
    return (key >> 20) % side if isinstance(key, np.ndarray) else F.pmod(F.shiftright(key, 20), F.lit(side))


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text (A-Z in lower case): counts per text, indices into the distinct words, and these."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    n = np.diff(words.offsets.to_numpy())
    flat = words.flatten().dictionary_encode()
    names, at = flat.dictionary.cast(pa.binary()).to_pylist(), flat.indices.to_numpy()
    if b"" in names:  # at the edges of a text
        real = at != names.index(b"")
        before = np.r_[0, np.cumsum(real)]
        ends = np.r_[0, np.cumsum(n)]
        n, at = np.diff(before[ends]), at[real]
    return n, at, names


def keys_of(names: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    keys = np.array([h(w) for w in names], np.uint64).view(np.int64)
    keys[keys == END_KEY] = 1
    return keys


def count_tokens(docs: DataFrame, id_col: str, text_col: str, flush_at: int = 1_000_000) -> DataFrame:
    """(key, c): training counts of all tokens, combined in each task before the shuffle."""
    rows = docs.filter(~held_out(id_col)).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out():
            keys, counts = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "c"])

        for b in batches:
            ends += b.num_rows
            for _, part in pieces(b.column(0)):
                _, at, names = word_table(part)
                held.append((keys_of(names), np.bincount(at, minlength=len(names))))
                size += len(names)
                if size > 2 * flush_at:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > flush_at:
                        yield out()
                        held, size = [], 0
        if ends:
            held.append((np.array([END_KEY]), np.array([ends])))
            yield out()

    return rows.mapInArrow(run, "key long, c long").filter("c > 0").groupBy("key").agg(F.sum("c").alias("c"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[list[tuple[int, bool]], pa.Array]]:
    """Texts, some at a time: (row, whether the text ends here) and the strings. A text over `most` bytes is cut at white space."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        if sizes[at] > most:
            raw, start = texts[at].as_buffer(), 0
            view = memoryview(raw)
            while start < len(view):
                end = min(start + most, len(view))
                while end < len(view) and view[end] not in b" \t\n\r\x0b\x0c":
                    end += 1
                yield [(at, end == len(view))], pa.array([bytes(view[start:end])], pa.binary()).cast(pa.string())
                start = end
            at += 1
            continue
        stop, held = at, 0
        while stop < len(texts) and held + sizes[stop] <= most:
            held += sizes[stop]
            stop += 1
        yield [(i, True) for i in range(at, stop)], texts[at:stop]
        at = stop


@dataclass
class Vocabulary:
    """Counts of the most frequent tokens (sorted by key) and their slots (-1: a rare slot), and totals over all tokens."""

    keys: np.ndarray
    counts: np.ndarray
    slots: np.ndarray
    rare_mass: np.ndarray
    tokens: int
    types: int

    @property
    def log_norm(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.types + 1)))

    @property
    def shape(self) -> Shape:
        return Shape.of(self.types)

    def codes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and its place among the known tokens (-1: none)."""
        at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
        known = self.keys[at] == keys
        slots = np.where(known, self.slots[at], -1)
        return np.where(slots < 0, rare_slot(keys, self.shape.side), slots), np.where(known, at, -1)


def vocabulary(counts: DataFrame, known: int = 262_144) -> Vocabulary:
    """Read the totals and at most `known` of the most frequent tokens of a table of counts."""
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    side, words = Shape.of(v).side, counts.filter(F.col("key") != END_KEY)
    mass = np.full(side, 0.5)  # for the unseen words of each rare slot
    for r in words.groupBy(rare_slot(F.col("key"), side).alias("slot")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        mass[r["slot"]] += r["m"]
    # Counts fall into at most some thousand classes, 64 for each doubling; whole classes are taken from the top, as many
    # as have `known` tokens together, so that no list of candidates meets in one place.
    kind = F.floor(F.log2("c") * 64).cast("int")
    taken, least = 0, None
    for r in words.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("kind")).collect():
        taken += r["n"]
        if taken > known:
            break
        least = r["kind"]
    top = words.filter(F.lit(False) if least is None else kind >= least).toPandas()
    top = top.sort_values(["c", "key"], ascending=[False, True], kind="stable")
    own = top["key"].to_numpy(np.int64)[: side * side - side - 1]
    np.subtract.at(mass, rare_slot(own, side), top["c"].to_numpy()[: len(own)] + 0.5)
    ends = counts.filter(F.col("key") == END_KEY).first()
    keys = np.r_[END_KEY, top["key"].to_numpy(np.int64)]
    slots = np.full(len(keys), -1)
    slots[: 1 + len(own)] = side + np.arange(1 + len(own))
    order = np.argsort(keys)
    c = np.r_[ends["c"] if ends else 0, top["c"].to_numpy(np.int64)]
    return Vocabulary(keys[order], c[order], slots[order], np.maximum(mass, 0.5), int(n or 0), int(v or 0))


@dataclass
class Stream:
    """Texts one after another, each with the words before it (BACK of them, or places before a text) and its end token."""

    key: np.ndarray  # of every place
    slot: np.ndarray
    known: np.ndarray  # place among the known tokens
    places: np.ndarray  # of the tokens to predict
    row: np.ndarray  # of each of these, the row of its text


def stream_of(v: Vocabulary, rows: list[tuple[int, bool]], texts: pa.Array, before: np.ndarray | None = None) -> Stream:
    """before: the last BACK keys of the text that the first piece goes on with."""
    n, at, names = word_table(texts)
    keys = keys_of(names)
    slots, known = v.codes(keys)
    last = np.array([e for _, e in rows], np.int64)
    starts = np.r_[0, np.cumsum(n + BACK + last)]
    place = np.arange(len(at)) + np.repeat(starts[:-1] + BACK - np.r_[0, np.cumsum(n)[:-1]], n)
    ends = (starts[1:] - 1)[last == 1]
    key, slot, know = np.full(starts[-1], BEGIN_KEY), np.zeros(starts[-1], np.int64), np.full(starts[-1], -1)
    key[place], slot[place], know[place] = keys[at], slots[at], known[at]
    end_slot, end_known = v.codes(np.array([END_KEY]))
    key[ends], slot[ends], know[ends] = END_KEY, end_slot[0], end_known[0]
    if before is not None:
        key[:BACK] = before
    target = np.ones(starts[-1], bool)
    for b in range(BACK):
        target[starts[:-1] + b] = False
    places = np.flatnonzero(target)
    row = np.repeat(np.array([i for i, _ in rows]), n + last)
    return Stream(key, slot, know, places, row)


def streams(v: Vocabulary, texts: pa.Array) -> Iterator[Stream]:
    before, left = None, None
    for rows, part in pieces(texts):
        s = stream_of(v, rows, part, before if left == rows[0][0] else None)
        done = rows[-1][1]
        left, before = (None, None) if done else (rows[-1][0], s.key[-BACK:])
        yield s


@dataclass
class Model:
    """Hashed weights: word (rows x 3 side), pair and member (rows x side)."""

    tables: list[np.ndarray]

    @classmethod
    def zero(cls, s: Shape) -> Model:
        return cls([np.zeros(x, np.float32) for x in ((s.word_rows, BACK * s.side), (s.pair_rows, s.side), (s.member_rows, s.side))])


def _row(hashed: np.ndarray, rows: int) -> np.ndarray:
    return (hashed >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64)


def features(s: Shape, key: np.ndarray, places: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed rows: of every place's word; of each predicted token's pair of words before; and, with its class, of w1, w1 w2, w2 and w3 (4 x n)."""
    k = key.view(np.uint64) * MIX[0]
    k ^= k >> np.uint64(29)
    w1, w2, w3 = (k[places - b] for b in (1, 2, 3))
    pair = (w1 * MIX[1] + w2) * MIX[2]
    c = cls.astype(np.uint64) * MIX[3]
    member = np.stack([_row((x ^ c) * m, s.member_rows) for x, m in ((w1, MIX[1]), (pair, MIX[2]), (w2, MIX[4]), (w3, MIX[5]))])
    return _row(k * MIX[2], s.word_rows), _row(pair * MIX[1], s.pair_rows), member


def unigram_logits(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Logits that the weights start from: of each class, and of each member of a class, by the counts; far below where no token is."""
    side = v.shape.side
    mass = np.zeros(side * side)
    mass[:side] = v.rare_mass
    own = v.slots >= 0
    mass[v.slots[own]] = v.counts[own] + 0.5
    mass = mass.reshape(side, side)
    total = mass.sum(1)
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), -1e4).astype(np.float32)
    return log(total / total.sum()), log(mass / np.maximum(total, 1e-300)[:, None])


def exp_logits(z: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits, in place, and their sums. Logits are held below 60, so nothing overflows."""
    z += start
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32)


def class_logits(m: Model, word: np.ndarray, pair: np.ndarray, places: np.ndarray, side: int) -> np.ndarray:
    """Sums over the features of each predicted place: one gather of all places' word rows serves w1, w2 and w3."""
    z = m.tables[1].take(pair, axis=0, mode="clip")
    own = m.tables[0].take(word, axis=0, mode="clip")
    for b in range(BACK):
        z += own[places - b - 1, b * side : (b + 1) * side]
    return z


def member_logits(m: Model, rows: np.ndarray) -> np.ndarray:
    z = m.tables[2].take(rows[0], axis=0, mode="clip")
    for f in rows[1:]:
        z += m.tables[2].take(f, axis=0, mode="clip")
    return z


def chunks(s: Stream, side: int, shape: Shape) -> Iterator[tuple[np.ndarray, ...]]:
    """(place in the part, slot, word, pair and member rows) of CHUNK tokens each; a part starts BACK places before its first token."""
    for at in range(0, len(s.places), CHUNK):
        p = s.places[at : at + CHUNK]
        lo = p[0] - BACK
        slot = s.slot[p]
        yield p - lo, slot, *features(shape, s.key[lo : p[-1] + 1], p - lo, slot // side)


class Trainer:
    """AdaGrad on the rows that a chunk has met, with one accumulated gain a row."""

    def __init__(self, v: Vocabulary, tables: list[np.ndarray] | None = None, gains: list[np.ndarray] | None = None):
        self.v, self.shape = v, v.shape
        self.model = Model([t.copy() for t in tables]) if tables else Model.zero(self.shape)
        self.gains = [g.copy() for g in gains] if gains else [np.full(len(t), 1e-2, np.float32) for t in self.model.tables]
        self.visits = [np.zeros(len(t), np.float32) for t in self.model.tables]
        self.class_start, self.member_start = unigram_logits(v)

    def descend(self, table: int, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows)
        ordered = rows[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        names, n = ordered[first], np.diff(np.r_[first, len(ordered)])
        g = grad.take(order[first], axis=0, mode="clip")
        if (many := n > 1).any():  # pairs of columns are added as complex numbers, which takes half the loops
            starts = np.r_[0, np.cumsum(n[many])[:-1]]
            part = grad.take(order[np.repeat(many, n)], axis=0, mode="clip").view(np.complex64)
            g[many] = np.add.reduceat(part, starts, axis=0).view(np.float32)
        gain = self.gains[table].take(names) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.gains[table][names] = gain
        g *= (-RATE / np.sqrt(gain))[:, None]
        w = self.model.tables[table]
        g += w.take(names, axis=0, mode="clip")
        w[names] = g
        self.visits[table][names] += n

    def add(self, texts: pa.Array) -> None:
        side = self.shape.side
        for s in streams(self.v, texts):
            for places, slot, word, pair, member in chunks(s, side, self.shape):
                cls, every = slot // side, np.arange(len(slot))
                p, total = exp_logits(class_logits(self.model, word, pair, places, side), self.class_start)
                p *= (1 / total)[:, None]
                p[every, cls] -= 1
                self.descend(1, pair, p)
                wide = np.zeros((len(word) + BACK, side), np.float32)
                wide[places] = p
                self.descend(0, word, np.concatenate([wide[b : b + len(word)] for b in range(1, BACK + 1)], axis=1))
                p, total = exp_logits(member_logits(self.model, member), self.member_start.take(cls, axis=0))
                p *= (1 / total)[:, None]
                p[every, slot % side] -= 1
                for f in member:
                    self.descend(2, f, p)

    def blocks(self) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
        """(table, block, rows that were met, their weights as float16, gains, visits)."""
        for t, (w, g, n) in enumerate(zip(self.model.tables, self.gains, self.visits, strict=True)):
            for b in range(0, len(w), BLOCK):
                met = np.flatnonzero(n[b : b + BLOCK])
                if len(met):
                    yield t, b // BLOCK, met.astype("<u2").tobytes(), *(x[b + met].astype(kind).tobytes() for x, kind in ((w, "<f2"), (g, "<f4"), (n, "<f4")))


PART = "tab int, block int, task int, met binary, w binary, g binary, n binary"


def _merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights and gains of one block's rows, averaged over the tasks that have met them by visits."""
    total, gain, n = None, np.zeros(BLOCK), np.zeros(BLOCK)
    for pdf in parts:
        for met, w, g, k in zip(pdf["met"], pdf["w"], pdf["g"], pdf["n"], strict=True):
            met, g, k = np.frombuffer(met, "<u2").astype(int), np.frombuffer(g, "<f4"), np.frombuffer(k, "<f4").astype(float)
            w = np.frombuffer(w, "<f2").reshape(len(met), -1)
            total = np.zeros((BLOCK, w.shape[1])) if total is None else total
            total[met] += w * k[:, None]
            gain[met] += g * k
            n[met] += k
    met = np.flatnonzero(n)
    w, g = total[met] / n[met, None], gain[met] / n[met]
    sent = (x.astype(kind).tobytes() for x, kind in ((met, "<u2"), (w, "<f2"), (g, "<f4"), (n[met], "<f4")))
    yield pd.DataFrame([(key[0], key[1], int(key[2]) // 64 if len(key) > 2 else 0, *sent)], columns=["tab", "block", "task", "met", "w", "g", "n"])


def fit(docs: DataFrame, v: Vocabulary, id_col: str, text_col: str, least_tokens: int = 2_000_000) -> Model:
    """Train on all training documents, a part of them a round; what reaches the driver is the model.

    A task trains on least_tokens tokens at least, as far as partitions can be put together without a shuffle: the more
    it sees, the less the average over tasks takes back, and the less weights travel for each document.
    """
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(16))
    rows = docs.filter(~held_out(id_col)).select(F.col(text_col).alias("text"), part.alias("part")).coalesce(max(1, v.tokens // least_tokens))
    sc = docs.sparkSession.sparkContext
    whole = Model.zero(v.shape)
    gains = [np.full(len(t), 1e-2, np.float32) for t in whole.tables]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    for begin, end in zip((0, *ROUNDS), ROUNDS, strict=False):
        sent = sc.broadcast((v, whole.tables, gains))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            t = Trainer(*sent.value)
            for b in batches:
                t.add(b.column(0))
            for found in t.blocks():
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(found, kinds, strict=True)], names=["tab", "block", "met", "w", "g", "n"])

        parts = rows.filter(f"part >= {begin} AND part < {end}").select("text").mapInArrow(run, "tab int, block int, met binary, w binary, g binary, n binary")
        # Two levels, so that no reducer gets a block from every task of a large cluster.
        few = parts.withColumn("task", F.expr("spark_partition_id() div 64")).groupBy("tab", "block", "task").applyInPandas(_merge, PART)
        for r in few.groupBy("tab", "block").applyInPandas(_merge, PART).toLocalIterator():
            at = r["block"] * BLOCK + np.frombuffer(bytes(r["met"]), "<u2").astype(int)
            whole.tables[r["tab"]][at] = np.frombuffer(bytes(r["w"]), "<f2").reshape(len(at), -1)
            gains[r["tab"]][at] = np.frombuffer(bytes(r["g"]), "<f4")
    return whole


class Scorer:
    def __init__(self, v: Vocabulary, m: Model):
        self.v, self.model, self.shape = v, m, v.shape
        self.class_start, self.member_start = unigram_logits(v)
        self.log_count, self.log_rare = np.log10(v.counts + 0.5), np.log10(v.rare_mass)

    def slot_logs(self, s: Stream) -> np.ndarray:
        """log10 of P(slot | context) of each token of a stream."""
        side, out = self.shape.side, [np.zeros(0)]
        for places, slot, word, pair, member in chunks(s, side, self.shape):
            cls, every = slot // side, np.arange(len(slot))
            a, total = exp_logits(class_logits(self.model, word, pair, places, side), self.class_start)
            logs = np.log10(np.maximum(a[every, cls], 1e-37)) - np.log10(total)
            b, total = exp_logits(member_logits(self.model, member), self.member_start.take(cls, axis=0))
            out.append(logs + np.log10(np.maximum(b[every, slot % side], 1e-37)) - np.log10(total))
        return np.concatenate(out)

    def batch(self, texts: pa.Array) -> list[np.ndarray | list]:
        """Columns, a row a text: n_tokens, n_known, base and model terms of the known tokens, and the other tokens' keys and times."""
        n, side = len(texts), self.shape.side
        tokens, known, base, model = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        keys: list[list] = [[] for _ in range(n)]
        times: list[list] = [[] for _ in range(n)]
        for s in streams(self.v, texts):
            row, at, slot = s.row, s.known[s.places], s.slot[s.places]
            if not len(row):
                continue
            here, rare = at >= 0, slot < side
            logs = np.where(here, self.log_count[at], 0.0)
            tokens += np.bincount(row, minlength=n)
            known += np.bincount(row, here & (self.v.counts[at] > 0), n).astype(np.int64)
            base += np.bincount(row, logs, n)
            model += np.bincount(row, self.slot_logs(s) + np.where(rare, logs - self.log_rare[np.where(rare, slot, 0)], 0.0), n)
            own, who = s.key[s.places[~here]], row[~here]
            order = np.lexsort((own, who))
            own, who = own[order], who[order]
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (who[1:] != who[:-1])]) if len(own) else np.zeros(0, np.int64)
            for r, k, t in zip(who[first].tolist(), own[first].tolist(), np.diff(np.r_[first, len(own)]).tolist(), strict=True):
                keys[r].append(k)
                times[r].append(t)
        return [tokens, known, base, model, keys, times]


@scoped
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = 262_144) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is trained on the rows whose crc32(id as text) mod 5 is not 1, and counts cover all their tokens.

    * null text: the end token alone; null id: in training; repeated rows: each trains and is scored;
    * very long texts: coded some MB at a time, the words before a piece going on to it; nothing is cut off;
    * words that are equally frequent at the end of the slots: the smaller hash has one;
    * no training rows: all words are unseen and the model is uniform; empty input: no rows. Other columns are not read.

    Tokens are told apart by a 64-bit hash, so at some 10^9 types and more single counts may be those of two words. `known`
    bounds the counts sent to all tasks (16 bytes each); the counts of all other tokens are joined by hash, one row per
    distinct token of a text, so no such key is hot.
    """
    counts = stash(count_tokens(docs, id_col, text_col), "counts")
    v = vocabulary(counts, known)
    m = fit(docs, v, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((v, m))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    schema = rows.select("row", "doc_id", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("model", "double"), ("keys", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", dict)
        s = Scorer(*sent.value)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                cols = [pa.array(c, k) for c, k in zip(s.batch(b.column(3)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=schema.names)

    scored = stash(rows.mapInArrow(run, schema), "scored")
    others = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("t")).select("row", F.col("t.keys").alias("key"), F.col("t.times").alias("times"))
    seen = others.join(counts.select("key", "c"), "key", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = seen.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"))
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    out = scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model").join(sums, "row", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", zero) - F.col("n_tokens") * F.lit(v.log_norm)).alias("base_score"),
        (F.col("model") + F.coalesce("logs", zero)).alias("score"),
    )
