"""Which texts occur inside longer ones: an equality join on minimizers, verified on the texts.

Of every window of consecutive grams a text keeps the least by hash. A window inside a contained text is a window of its
container, too, so all that a text keeps its containers keep. A text asks for its containers by one that it keeps, one
which few texts of its length keep, together with the letters to both sides of the gram, so that passages which many texts
have do not bring them all together; long texts keep fewer and longer grams. What is asked for goes to all tasks as bits
of tables of bounded size, for each scale one of the keys and three of more and more letters beside them, so that of all
that containers keep little more than what some text asks for is shuffled.

The texts are read from their source for each step, and only keys, ids and sizes are shuffled or written; of the texts
themselves only those that answer a question, and theirs that ask it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import spread
from tessera.sources.rounds import settle

#: (characters of a gram, grams of a window): a text asks by the last one that fits into it, as a container it keeps all that fit.
SCALES = ((10, 1), (12, 2), (15, 3), (20, 5), (26, 9), (36, 21), (60, 41), (100, 81), (170, 151), (290, 271), (500, 481), (900, 801), (1600, 1401), (3000, 2601))
SPANS = np.array([g + w - 1 for g, w in SCALES])
SHORTEST = sum(SCALES[0]) - 1
#: A table of keys has 2 to the power of so many bits at least (if that many are allowed) and at most, 16 MB; with more keys more is shuffled for nothing. The driver gets so many words of 64 bits at a time.
LEAST_BITS, MOST_BITS = 20, 27
MOST_WORDS = 1 << 22
#: Letters that a question may have to the left and to the right of its gram, at first: as many as the text has, or the next fewer of these; and up to how many more.
STEPS = np.array([0, 1, 2, 3, *(x << i for i in range(11) for x in (4, 6))])
GAPS = np.r_[np.diff(STEPS), 2 << 10]
#: What a text asks by, each more than the one before: the key, the gram with letters by STEPS, with all on the left, with all on both sides.
ASKED = ("g", "steps", "left", "q")
#: Keys that so many texts keep are told apart when a text chooses the one it asks by.
COMMON = (2, 8, 64, 512, 4096, 32768)
#: So many letters are read at a time, or one text.
PIECE = 1 << 16
TIMES = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.full((2, n), np.array([[TIMES], [pow(TIMES, -1, 1 << 64)]], np.uint64))
    both[:, 0] = 1
    return tuple(np.multiply.accumulate(both, axis=1))


_cached_powers = lru_cache(1)(_made_powers)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of TIMES and of its inverse."""
    up, down = _cached_powers(PIECE) if n <= PIECE else _made_powers(n)
    return up[:n], down[:n]


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Piece:
    """Some texts one after another by falling size, so that those of a scale, and those of it and all above, follow each other."""

    def __init__(self, texts: list[str], size: np.ndarray):
        order = np.argsort(-size, kind="stable")
        letters = np.frombuffer("".join([texts[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = size[order].astype(np.int64)
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.order = order
        self.of = np.repeat(np.arange(len(order)), size)
        self.room = (np.repeat(self.stop, size) - np.arange(len(letters))).astype(np.int32)
        up, self.down = _powers(len(letters))
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((letters + np.uint64(1)) * up, out=self.sums[1:])
        #: How many texts a scale fits into.
        self.fit = np.searchsorted(-size, -SPANS, "right")

    def _hashes(self, at: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[at]) * self.down[at]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def minimizers(self, scale: int, own: bool, table: np.ndarray | None = None) -> _Runs:
        """What texts keep at a scale, all that it fits into or those whose own it is, and only what the table has; the same key may come again."""
        first = int(self.fit[scale + 1]) if own and scale + 1 < len(SCALES) else 0
        last = int(self.fit[scale])
        (gram, window), span = SCALES[scale], int(SPANS[scale])
        if first >= last:
            none = np.zeros(0, np.int64)
            return _Runs(0, none.view(np.uint64), none, none, none.view(np.uint64))
        a, b = int(self.start[first]), int(self.stop[last - 1])
        h = self._hashes(slice(a, b - gram + 1), slice(a + gram, b + 1))
        least = _least_of(h, window)
        fresh = np.empty(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=fresh[1:])
        fresh[self.start[first:last] - a] = True
        at = np.flatnonzero(fresh)
        which = np.flatnonzero(self.room[a : a + len(least)][at] >= span)
        key = _mixed(least[at[which]] + np.uint64(scale * TIMES % (1 << 64)))  # the least of hashes are no evenly spread keys
        if table is not None:
            known = _has(table, key)
            which, key = which[known], key[known]
        begin, end = at[which], np.append(at, len(least))[which + 1]
        return _Runs(a, h, begin, np.minimum(end - 1 + window, begin + self.room[a + begin] - gram + 1), key)

    def owners(self, runs: _Runs) -> np.ndarray:
        return self.of[runs.base + runs.at]

    def question(self, scale: int, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A key of the grams at `at` with so many letters on their left and right."""
        h = self._hashes(at - left, at + SCALES[scale][0] + right)
        return _mixed(_mixed(h + np.uint64((scale + 1) * TIMES % (1 << 64))) + (left * 16384 + right).astype(np.uint64) * np.uint64(TIMES))


class _Runs(NamedTuple):
    """Windows one after another with the same least gram: hashes of all grams from `base` on, where in them runs begin and their grams end, their keys."""

    base: int
    hashes: np.ndarray
    at: np.ndarray
    end: np.ndarray
    key: np.ndarray

    def some(self, which: np.ndarray) -> _Runs:
        return self._replace(at=self.at[which], end=self.end[which], key=self.key[which])

    def places(self, scale: int, all_of_them: bool) -> tuple[np.ndarray, np.ndarray]:
        """(run, place) of a run's least grams, the first or all."""
        which, found = [], []
        window = SCALES[scale][1]
        for i, (at, end) in enumerate(zip(self.at.tolist(), self.end.tolist(), strict=True)):
            part = self.hashes[at:end]
            if all_of_them:
                x = np.flatnonzero(part == part[:window].min()) + at
                found.append(x)
                which.append(np.full(len(x), i))
            else:
                found.append([at + int(part[:window].argmin())])
                which.append([i])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(which), join(found) + self.base


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, _Piece]]:
    """(ids, sizes, texts) of some rows at a time."""
    for whole in batches:
        size, at = pc.utf8_length(whole.column(1)).to_numpy().astype(np.int64), 0
        ends = np.cumsum(size)
        while at < whole.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield whole.column(0).slice(at, stop - at), size[at:stop].astype(np.int32), _Piece(whole.column(1).slice(at, stop - at).to_pylist(), size[at:stop])
            at = stop


def _once(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    once = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])][: len(of)]
    return of[once], key[once]


def _has(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys have all their bits in the table; a key's first bits tell the word, its last ones three bits in it."""
    word, which = table[(key >> np.uint64(65 - len(table).bit_length())).astype(np.int64)], np.arange(len(key))
    for i in range(3):
        known = (word >> ((key >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
        word, key, which = word[known], key[known], which[known]
    return which


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What texts keep at their own scale, once a text."""
    for _, _, piece in _pieces(batches):
        runs = [piece.minimizers(scale, own=True) for scale in range(len(SCALES))]
        _, key = _once(np.concatenate([piece.owners(x) for x in runs]), np.concatenate([x.key for x in runs]))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["g"])


def _asks(sent):
    """What each text asks by. Of what it keeps at its own scale the key is one that few keep, as the tables of common keys tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for ids, size, piece in _pieces(batches):
            found = []
            for scale in range(len(SCALES)):
                runs = piece.minimizers(scale, own=True)
                if not len(runs.at):
                    continue
                of, how = piece.owners(runs), np.zeros(len(runs.at), int)
                for table in common.values():
                    how[_has(table, runs.key)] += 1
                order = np.lexsort((runs.at, runs.key, how, of))
                runs = runs.some(order[np.r_[True, of[order][1:] != of[order][:-1]]])
                of = piece.owners(runs)
                _, at = runs.places(scale, all_of_them=False)
                beside = (at - piece.start[of], piece.stop[of] - at - SCALES[scale][0])
                step = [np.searchsorted(STEPS, x, "right") - 1 for x in beside]
                (left, right), (all_left, all_right) = [STEPS[x] for x in step], [np.minimum(x, STEPS[i] + GAPS[i] - 1) for x, i in zip(beside, step, strict=True)]
                asked = runs.key, piece.question(scale, at, left, right), piece.question(scale, at, all_left, right), piece.question(scale, at, all_left, all_right)
                found.append((of, np.full(len(of), scale), *(x.view(np.int64) for x in asked)))
            if found:
                of, scales, *asked = (np.concatenate(x) for x in zip(*found, strict=True))
                mine = piece.order[of]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), pa.array(size[mine], pa.int32()), pa.array(scales, pa.int32()), *map(pa.array, asked)], names=["id", "size", "scale", *ASKED])

    return run


@lru_cache
def _reach(scale: int) -> tuple[np.ndarray, np.ndarray]:
    """All (left, right) of questions at a scale."""
    left, right = (x.ravel() for x in np.meshgrid(STEPS, STEPS))
    may = SCALES[scale][0] + left + right < (SPANS[scale + 1] if scale + 1 < len(SCALES) else np.inf)
    return left[may], right[may]


def _asked_of(piece: _Piece, scale: int, places: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, question) of all questions that the tables have and that the texts' grams at some places answer."""
    left, right = _reach(scale)
    before, after = (lambda at: at - piece.start[piece.of[at]]), (lambda at: piece.stop[piece.of[at]] - at - SCALES[scale][0])
    row, column = np.nonzero((before(places)[:, None] >= left) & (after(places)[:, None] >= right))
    at, left, right = places[row], left[column], right[column]
    key = piece.question(scale, at, left, right)
    known = _has(tables[0], key)
    at, left, right = at[known], left[known], right[known]
    for side, table in enumerate(tables[1:]):
        gap = GAPS[np.searchsorted(STEPS, right if side else left)]
        row = np.repeat(np.arange(len(at)), gap)
        more = np.arange(len(row)) - np.repeat(np.cumsum(gap) - gap, gap)
        at, left, right = at[row], left[row] + (0 if side else more), right[row] + (more if side else 0)
        fits = (after(at) >= right) if side else (before(at) >= left)
        at, left, right = at[fits], left[fits], right[fits]
        key = piece.question(scale, at, left, right)
        known = _has(table, key)
        at, left, right, key = at[known], left[known], right[known], key[known]
    return piece.of[at], key


def _answers(sent, bits: int | None = None, common=None):
    """Questions that each text may answer, as the scale's tables of all that is asked by tell (with bits given one table serves for all).

    At its own scale a text answers by keys that others keep there, too, if common tells which.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value if bits is None else dict.fromkeys(range(len(ASKED) * len(SCALES)), sent.value)
        shared = common.value.get(0, np.zeros(1 << (LEAST_BITS - 6), np.uint64)) if common else None
        for ids, size, piece in _pieces(batches):
            found = [(piece.of[:0], np.zeros(0, np.uint64))]
            for scale in range(len(SCALES)):
                if len(ASKED) * scale not in tables:
                    continue
                by, *more = (tables[len(ASKED) * scale + i] for i in range(len(ASKED)))
                runs = piece.minimizers(scale, own=False, table=by)
                if shared is not None and len(runs.at):
                    may = piece.owners(runs) < (piece.fit[scale + 1] if scale + 1 < len(SCALES) else 0)
                    may[_has(shared, runs.key)] = True
                    runs = runs.some(may)
                _, places = runs.places(scale, all_of_them=True)
                found += [_asked_of(piece, scale, places[i : i + 1000], more) for i in range(0, len(places), 1000)]
            of, key = _once(*(np.concatenate(x) for x in zip(*found, strict=True)))
            if len(of):
                mine = piece.order[of]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), pa.array(size[mine], pa.int32()), pa.array(key.view(np.int64))], names=["id", "size", "q"])

    return run


def _tables(keys: DataFrame, most_bits: int) -> dict[int, np.ndarray]:
    """For each kind a table of its keys (kind, g), words of which each g sets three bits in one: some 64 bits for each g, up to 2 ** most_bits."""
    bits = {r["kind"]: min(most_bits, max(LEAST_BITS, (64 * r["count"]).bit_length())) for r in keys.groupBy("kind").count().collect()}
    if not bits:
        return {}
    of_kind = F.element_at(F.create_map(*(F.lit(x) for kv in bits.items() for x in kv)), F.col("kind"))
    mask = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(g, {6 * i}) & 63 AS int))" for i in range(3))
    words = keys.select("kind", "g", of_kind.alias("b")).groupBy("kind", F.expr("shiftrightunsigned(g, 70 - b)").alias("word")).agg(F.bit_or(F.expr(mask)).alias("bits"))
    out, at_once = {k: np.zeros(1 << (b - 6), np.uint64) for k, b in bits.items()}, [[]]
    for k in out:
        if at_once[-1] and sum(len(out[x]) for x in at_once[-1]) + len(out[k]) > MOST_WORDS:
            at_once.append([])
        at_once[-1].append(k)
    words = words if len(at_once) == 1 else settle(words)
    for some in at_once:
        kind, word, value = (x.to_numpy() for x in words.filter(F.col("kind").isin(some)).toArrow().itercolumns())
        for k in some:
            mine = kind == k
            out[k][word[mine]] = value[mine].view(np.uint64)
    return out


def _table(asked: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """A single table of all g, and of how many bits, as a power of two."""
    table = _tables(asked.select(F.lit(0).alias("kind"), "g"), most_bits).get(0, np.zeros(1 << (min(most_bits, LEAST_BITS) - 6), np.uint64))
    return table, 5 + len(table).bit_length()


def _hashed(ids: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(TIMES)))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_hashed(b.column(0).to_numpy()).view(np.int64))], names=["g"])


def contained_rows(rows: DataFrame, kept: DataFrame | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows (id long, t) whose text occurs inside a longer one, each once; texts under SHORTEST characters take no part, nor do null ones.

    rows are read several times and must come out the same each time, with an id of their own, as those of a table do. Of
    equal texts one should take part only: kept has the ids of those that do (none given: all). It is read several times, too.
    """
    send = rows.sparkSession.sparkContext.broadcast
    taken = (lambda df, by: df) if kept is None else (lambda df, by: df.join(kept.select(F.col("id").alias(by)), by, "left_semi"))
    rows = rows.select("id", "t").filter(F.length("t") >= SHORTEST)
    each = spread(rows)
    counts = settle(each.mapInArrow(_keys, "g long").groupBy("g").count().filter(F.col("count") >= COMMON[0]))
    kinds = F.explode(F.filter(F.array(*(F.when(F.col("count") >= n, i) for i, n in enumerate(COMMON))), lambda x: x.isNotNull()))
    common = send(_tables(counts.select(kinds.alias("kind"), "g"), most_bits))
    asked = settle(taken(each.mapInArrow(_asks(common), "id long, size int, scale int, " + ", ".join(f"{c} long" for c in ASKED)), "id"))
    each_asked = F.inline(F.array(*(F.struct((F.col("scale") * len(ASKED) + i).alias("kind"), F.col(c).alias("g")) for i, c in enumerate(ASKED))))
    tables = send(_tables(asked.select(each_asked), most_bits))
    outer = settle(taken(each.mapInArrow(_answers(tables, common=common), "oid long, outer_size int, q long"), "oid"))
    for done in (common, tables):
        done.destroy()
    match = asked.join(outer, "q").filter("outer_size > size").select("id", "oid", "outer_size")
    # One container is enough: the longest that may be one is tried first, the others only where that was none.
    first = settle(match.groupBy("id").agg(F.max(F.struct("outer_size", "oid")).alias("m"), F.count(F.lit(1)).alias("n")).select("id", "m.oid", "n"))
    found = settle(_verified(rows, first.select("id", "oid"), most_bits))
    left = first.filter("n > 1").join(found, "id", "left_anti").select("id", F.col("oid").alias("tried"))
    others = settle(match.join(left, "id").filter("oid <> tried").select("id", "oid"))
    return found if others.isEmpty() else found.unionByName(_verified(rows, others, most_bits))


def _verified(rows: DataFrame, pairs: DataFrame, most_bits: int) -> DataFrame:
    """Rows (id, t) of pairs (id, oid) whose text is in that of oid, each once. Only texts of pairs are shuffled, and what the bits of a table let through."""
    needed = rows.sparkSession.sparkContext.broadcast(_table(pairs.select(F.explode(F.array("id", "oid")).alias("id")).mapInArrow(_hashes, "g long"), most_bits)[0])

    @F.pandas_udf("boolean")
    def may(ids: pd.Series) -> pd.Series:
        out = np.zeros(len(ids), bool)
        out[_has(needed.value, _hashed(ids.to_numpy()))] = True
        return pd.Series(out)

    texts = settle(rows.filter(may("id")))
    both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("oid"), F.col("t").alias("outer")), "oid")
    return both.filter(F.contains("outer", "t")).select("id", "t").dropDuplicates(["id"])


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def firsts(rows: DataFrame) -> DataFrame:
    """(digest, id): the least id of each text of rows (id, t)."""
    return rows.groupBy(digest("t").alias("digest")).agg(F.min("id").alias("id"))


def contained(texts: DataFrame, text: str = "content", most_bits: int = MOST_BITS) -> DataFrame:
    """The distinct texts that occur inside a longer one (column `text`); texts under SHORTEST characters take no part, nor do null ones."""
    rows = settle(texts.select(F.monotonically_increasing_id().alias("id"), F.col(text).alias("t")).filter(F.length("t") >= SHORTEST))
    return contained_rows(rows, settle(firsts(rows)).select("id"), most_bits).select(F.col("t").alias(text))
