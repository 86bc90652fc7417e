"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints that differ in at most two bits are cut into two segments, fewer than the three that equal segments would
need: one of the two then differs in at most one bit. Each segment is indexed under its 32 one-wildcard variants, and
equal variants are joined and verified by counting bits. Two segments within one bit of each other share the variant
whose wildcard is that bit, so no link is lost.

Links are kept as stars inside a bucket, as only reachability is asked for: a bucket of n fingerprints yields at most
n - 1 edges, and no list of all pairs is ever made.

similar_groups links texts by the Jaccard similarity of their shingle sets. Nearly equal texts are gathered by the same
deletion variants of their fingerprints and verified. At a similarity of 0.8 fingerprints differ in a sixth of their
bits, so segments short enough to agree are shared by a fixed part of all pairs. Beyond two bits candidates are therefore
gathered by bands of minimum hashes, whose keys texts share only if they share shingles; fingerprints rank them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import scoped, stash, worker_cache
from .components import components, joined

BITS, SEGMENT, SEED = 64, 32, 42
#: Bands of so many minimum hashes each: a pair with a similarity of 0.8 shares one with a probability of 0.999, one of 0.4 with 0.05.
BANDS, ROWS = 30, 7
#: Sets of up to SHORT shingles have a minimum for each of as many hash functions, those of LONG or more one for each of as many bins; those between have both.
LONG, SHORT = 1024, 1280
GAP = re.compile(rb"[ \t-\r]")


def shingle_blocks(text: bytes, words: int, block: int = 1 << 20) -> Iterator[list[int]]:
    """XXH64 of each run of `words` words (fewer words: of the whole sequence; none: no hash), repeats included.

    A text is split about `block` bytes at a time, the last words of a block going on to the next one, so that the lists
    of a very long text stay small.
    """
    join, h, at, held, none = b" ".join, xxhash.xxh64_intdigest, 0, [], True
    while at < len(text):
        end = len(text)
        if at + block < end and (gap := GAP.search(text, at + block)):
            end = gap.start()
        w = text[at:end].lower().split() if at or end < len(text) else text.lower().split()
        w, at = held + w if held else w, end
        if len(w) >= words:
            none = False
            yield [h(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]
            held = w[len(w) - words + 1 :]
        else:
            held = w
    if none and held:
        yield [h(join(held), SEED)]


def bit_counts(hashes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """Signed 64-bit form of the fingerprint of n hashes: a bit is set where over half of them have it (none: 0)."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def shingle_hashes(text: bytes, words: int) -> list[int]:
    return [h for part in shingle_blocks(text, words) for h in part]


def fingerprint(hashes: list[int], block: int = 1 << 16) -> int:
    return majority(bit_counts(np.array(hashes, np.uint64), block), len(hashes))


def text_fingerprint(text: bytes, words: int) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for part in shingle_blocks(text, words):
        ones += bit_counts(np.array(part, np.uint64))
        n += len(part)
    return majority(ones, n)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row, in the order of the input and without a shuffle. Null text: no words, fingerprint 0."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", dict)  # other operators' caches are of no use here
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = pa.array([text_fingerprint(t.as_py() or b"", words) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def variants(distinct: DataFrame) -> DataFrame:
    """64 rows (key, fp) for each fingerprint: segment and wildcard position above the segment's other 31 bits."""
    at = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("at"))
    half = "CASE WHEN at >= 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    return at.select(F.expr(f"(({half}) & ~shiftleft(1L, at % 32)) | shiftleft(cast(at AS long), 32)").alias("key"), "fp")


def _linked(fps: np.ndarray, distance: int, block: int = 512) -> np.ndarray:
    """For each of the sorted fingerprints of a bucket, the index of the least one it reaches by verified links in the bucket."""
    n = len(fps)
    label, u = np.arange(n), fps.view(np.uint64)
    while True:
        before = label.copy()
        for i in range(0, n, block):
            near = np.bitwise_count(u[i : i + block, None] ^ u[None, :]) <= distance
            label[i : i + block] = np.where(near, label[None, :], n).min(1)
        label = label[label]
        if np.array_equal(before, label):
            return label


def complete_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, many at a time, from batches sorted by their first column (the key)."""
    held = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last:
            yield [r[:last] for r in rows]
        held = [r[last:] for r in rows]
    if held is not None:
        yield held


def _bucket_edges(distance: int):
    """Reads (key, fp) sorted by both; yields verified star edges of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in complete_buckets(batches):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= distance
            a, b = [fps[two[near]]], [fps[two[near] + 1]]
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = fps[at : at + n]
                label = _linked(own, distance)
                off = np.flatnonzero(label != np.arange(n))
                a.append(own[label[off]])
                b.append(own[off])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def crowded_segments(distinct: DataFrame, bound: int) -> DataFrame:
    """(half, seg): halves of fingerprints that more than bound / 2 fingerprints have; counts are combined before the shuffle.

    A variant's bucket joins two segments, so each bucket of more than `bound` has one of these, and a list of them has
    fewer than 4 / bound rows a fingerprint.
    """
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.expr("fp & 4294967295L").alias("seg")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("seg"))))
    return distinct.select(halves.alias("h")).select("h.*").groupBy("half", "seg").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound / 2).select("half", "seg")


def fingerprint_edges(distinct: DataFrame, distance: int = 2, bucket_bound: int = 20_000) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at most `distance` bits apart (0 to 2).

    Buckets of up to bucket_bound fingerprints are verified in one task. Those that may have more are counted first and
    never meet in one place: their fingerprints are linked by two-wildcard variants of all 64 bits instead. Those that
    share one are within two bits by construction, so a grouped minimum, combined before the shuffle, links them
    without comparing pairs.
    """
    if not 0 <= distance <= 2:
        raise ValueError("two segments with one wildcard find fingerprints up to two bits apart")
    crowded = stash(crowded_segments(distinct, bucket_bound), "crowded")
    keyed, edges = variants(distinct), None
    if not crowded.isEmpty():
        bit = F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))).alias("bit")
        keys = crowded.select("half", "seg", bit).selectExpr("(seg & ~shiftleft(1L, bit)) | shiftleft(cast(half * 32 + bit AS long), 32) AS key").distinct()
        keys = stash(keys, "crowded-keys")
        large = keyed.join(keys, "key", "left_semi").select("fp").distinct()
        keyed = keyed.join(keys, "key", "left_anti")
        edges = _wildcard_edges(large, distance)
    sorted_rows = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = sorted_rows.mapInArrow(_bucket_edges(distance), "a long, b long")
    return (found if edges is None else found.union(edges)).distinct()


def _wildcard_edges(large: DataFrame, distance: int) -> DataFrame:
    """Links of all fingerprints in `large` that are at most `distance` bits apart, as stars over shared two-wildcard variants."""
    if distance < 2:
        pos = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda p: F.struct(p.alias("p"), p.alias("q"))))
    else:
        pos = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS - 2)), lambda p: F.transform(F.sequence(p + 1, F.lit(BITS - 1)), lambda q: F.struct(p.alias("p"), q.alias("q"))))))
    wild = large.filter(F.lit(distance > 0)).select("fp", pos.alias("w")).selectExpr("fp", "w", "fp & ~(shiftleft(1L, w.p) | shiftleft(1L, w.q)) AS rest")
    least = wild.groupBy("w", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").drop("z")
    return wild.join(least, ["w", "rest"]).filter("a <> fp").select("a", F.col("fp").alias("b"))


def near_groups(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket_bound: int = 20_000) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the least id reachable, itself included).

    * null text and texts without words: fingerprint zero, linked like any other;
    * null ids are compared too; a component of null ids only has a null component_id;
    * repeated rows: each is returned; empty input: no rows. Other columns are not read.
    """
    fps = stash(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(fingerprint_edges(distinct.select("fp"), distance, bucket_bound))
    rep = stash(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "labels")
    ids = rep.groupBy("component").agg(F.min("least").alias("component_id"))
    label = rep.join(ids, "component").select("fp", "component_id")
    return fps.join(label, "fp").select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash, by the finaliser of SplitMix64."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _odd(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(27))) | np.uint64(1)


TIMES = _odd(BANDS * ROWS)


def band_keys(shingles: np.ndarray) -> list[int]:
    """The bands of a sorted set of shingle hashes; two sets share a key only if all minima of a band agree."""
    kinds, n = [], len(TIMES)
    if 0 < len(shingles) <= SHORT:
        kinds.append((0, (shingles[None, :] * TIMES[:, None]).min(axis=1)))
    if len(shingles) >= LONG:
        at = np.searchsorted(shingles, np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n))
        least = shingles[np.minimum(at, len(shingles) - 1)]
        least[at == np.append(at[1:], len(shingles))] = np.uint64((1 << 64) - 1)  # an empty bin
        kinds.append((BANDS, least))
    return [_signed(xxhash.xxh3_64_intdigest(x[i * ROWS : (i + 1) * ROWS].tobytes(), seed=seed + i)) for seed, x in kinds for i in range(BANDS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_sets(docs: DataFrame, words: int, id_col: str, text_col: str, with_sets: bool) -> DataFrame:
    """(id, f1, f2, node) for each row: 128 bits of fingerprint over the set of shingles, and the set's hash; then the keys of its bands, or with_sets the set itself as sorted 8-byte hashes."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("f1", "long").add("f2", "long").add("node", "long")
    schema = schema.add("shingles", "binary") if with_sets else schema.add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", dict)  # other operators' caches are of no use here
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            out: list[list] = [[], [], [], []]
            for t in b.column(1).cast(pa.binary()):
                parts = [np.unique(np.array(p, np.uint64)) for p in shingle_blocks(t.as_py() or b"", words)]
                own = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)
                raw = own.tobytes()
                row = (majority(bit_counts(own), len(own)), majority(bit_counts(_second(own)), len(own)), xxhash.xxh3_64_intdigest(raw), raw if with_sets else band_keys(own))
                for held, x in zip(out, row, strict=True):
                    held.append(x)
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(np.array(out[2], np.uint64).view(np.int64))]
            cols.append(pa.array(out[3], pa.binary() if with_sets else pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def band_rows(nodes: DataFrame) -> DataFrame:
    """A row (key, f1, f2, node and what else is given) for each band of each node."""
    return nodes.select(F.explode("bands").alias("key"), *(c for c in nodes.columns if c != "bands"))


def _near_rows(f1: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most_bits: int, small: int = 64, block: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, earlier row) of the same bucket whose first 64 bits differ in at most most_bits: small buckets together, by their rows' distance in the order, others in blocks."""
    u, which = f1.view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    own = np.flatnonzero(np.repeat((sizes <= small) & (sizes > 1), sizes))
    x, k = u[own], which[own]
    for step in range(1, small):
        near = np.flatnonzero((np.bitwise_count(x[step:] ^ x[:-step]) <= most_bits) & (k[step:] == k[:-step]))
        if len(near):
            yield own[near + step], own[near]
    for at, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        for i in range(1, n, block):
            stop = min(i + block, n)
            near = np.bitwise_count(u[at + i : at + stop, None] ^ u[None, at : at + stop - 1]) <= most_bits
            near &= np.arange(stop - 1)[None, :] < np.arange(i, stop)[:, None]
            row, earlier = np.nonzero(near)
            yield at + i + row, at + earlier


def _candidates(distance: int, most: int, known: bool, dealt: bool, least: float = 0.8):
    """Reads (key, f1, f2, node[, comp, size, shared][, home]) sorted by key; yields pairs (a, b, bits) with key null, and (key, a) for the ends of pairs beyond a node's `most` in the bucket (home).

    known: pairs within a component do not count, nor those whose shared shingles are too few for a similarity of `least`.
    """
    apart = min(distance, 26)  # of 64 bits; texts that are alike by 0.8 differ in about ten

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f1, f2, nodes, *more in complete_buckets(batches):
            home = more.pop() if dealt else keys
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            found = []
            for row, earlier in _near_rows(f1, starts, np.diff(np.r_[starts, len(keys)]), apart):
                if known:
                    comp, size, shared = more
                    both = np.minimum(shared[row], shared[earlier])
                    open_ = (comp[row] != comp[earlier]) & (both >= least * (size[row] + size[earlier] - both))
                    row, earlier = row[open_], earlier[open_]
                bits = np.bitwise_count((f1[row] ^ f1[earlier]).view(np.uint64)).astype(np.int32) + np.bitwise_count((f2[row] ^ f2[earlier]).view(np.uint64))
                mine = (bits <= distance) & (nodes[row] != nodes[earlier])
                if mine.any():
                    found.append((row[mine], earlier[mine], bits[mine]))
            if not found:
                continue
            row, earlier, bits = (np.concatenate(z) for z in zip(*found, strict=True))
            order = np.lexsort((earlier, bits, row))
            row, earlier, bits = row[order], earlier[order], bits[order]
            taken = np.arange(len(row)) - np.searchsorted(row, row) < most
            left = np.unique(np.concatenate([row[~taken], earlier[~taken]]))
            row, earlier, bits = row[taken], earlier[taken], bits[taken]
            none = pa.nulls(len(left), pa.int64())
            cols = [(pa.nulls(len(row), pa.int64()), pa.array(home[left])), (pa.array(nodes[earlier]), pa.array(nodes[left])), (pa.array(nodes[row]), none), (pa.array(bits, pa.int32()), none.cast(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], names=["key", "a", "b", "bits"])

    return run


def candidate_pairs(rows: DataFrame, distance: int, most: int, bucket_bound: int = 20_000, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, bits) of rows (key, f1, f2, node[, comp, size, shared]) that share a key and whose 128 bits differ in at most `distance`.

    In a key's bucket a node meets its `most` nearest earlier ones only; the ends of the pairs beyond are returned with
    the bucket's key (key and a set), so that the caller may look there again, at these rows alone; a pair may be named by
    several buckets. Buckets of more than bucket_bound nodes are dealt over tasks in which every two of
    their parts meet.
    """
    known, shape = "comp" in rows.columns, "key long, a long, b long, bits int"

    def look(rows: DataFrame, dealt: bool) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "f1", "f2", "node").mapInArrow(_candidates(distance, most, known, dealt, least), shape)

    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_bound)
    crowded = stash(crowded.select("key", F.ceil(F.col("n") * 2 / bucket_bound).cast("int").alias("g")), "crowded")
    if crowded.isEmpty():
        return stash(look(rows, False), "candidates")
    dealt = rows.join(crowded, "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("home", F.col("key")).withColumn("key", F.xxhash64("home", F.least("p", "q"), F.greatest("p", "q"))).select(*(c for c in rows.columns), "home")
    return stash(look(rows.join(crowded, "key", "left_anti"), False).union(look(dealt, True)), "candidates")


def _common(flat: np.ndarray, of: np.ndarray, n: int):
    """A function that counts, for a row's shingles, how many of them each of the n rows has; (flat, of) are all rows' shingles with their row, sorted by shingle."""

    def count(own: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        size = last - first
        at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.bincount(of[at], minlength=n)

    return count


def _star(u1: np.ndarray, u2: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], distance: int, apart: int, least: float) -> list[tuple[int, int]]:
    """Links of one bucket's rows: of all pairs between different components that differ in few bits and are truly alike, only those that join two components."""
    n, size = len(sets), np.array([len(x) for x in sets])
    _, label = np.unique(comp, return_inverse=True)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    common, links = _common(flat[order], np.repeat(np.arange(n), size)[order], n), []
    for i in range(1, n):
        first = np.bitwise_count(u1[:i] ^ u1[i])
        near = np.flatnonzero((label[:i] != label[i]) & (first <= apart) & (first.astype(np.int32) + np.bitwise_count(u2[:i] ^ u2[i]) <= distance))
        if not len(near):
            continue
        if len(near) > 8:
            both = common(sets[i])[near]
        else:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near.tolist()])
        for j in near[both >= least * (size[i] + size[near] - both)].tolist():
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _joining(distance: int, least: float):
    """Reads (key, f1, f2, node, comp, shingles) sorted by key; yields (a, b) of a bucket's nodes that are alike and join two components, fewer than the bucket has nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f1, f2, nodes, comp, raw in complete_buckets(batches):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            a, b = [], []
            for at, stop in zip(starts.tolist(), np.r_[starts[1:], len(keys)].tolist(), strict=True):
                if (comp[at:stop] == comp[at]).all():
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in raw[at:stop]]
                for i, j in _star(f1[at:stop].view(np.uint64), f2[at:stop].view(np.uint64), comp[at:stop], sets, distance, min(distance, 26), least):
                    a.append(nodes[at + i])
                    b.append(nodes[at + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _joined_buckets(rows: DataFrame, distance: int, least: float, bucket_bound: int) -> DataFrame:
    """Links (a, b) that join the components of all alike rows (key, f1, f2, node, comp, shingles) which share a key. Pairs are verified where a bucket meets, so that no list of them is made.

    Buckets of one component are left out; those of more than bucket_bound nodes are dealt as in candidate_pairs.
    """
    names = rows.select("key", "node", "comp")
    buckets = names.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    buckets = stash(buckets.select("key", F.when(F.col("n") > bucket_bound, F.ceil(F.col("n") * 2 / bucket_bound)).otherwise(1).cast("int").alias("g")), "buckets")
    dealt = rows.join(buckets, "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("key", F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q"))).select("key", "f1", "f2", "node", "comp", "shingles")
    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_joining(distance, least), "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


@scoped
def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 36, most: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_bound: int = 20_000) -> DataFrame:
    """One row per input row: id, component_id (the least id reachable over pairs of shingle similarity >= least, itself included).

    A text has a fingerprint of 128 bits over its set of shingles, and bands of minimum hashes. First the fingerprints'
    first 64 bits are linked by deletion variants (fingerprint_edges) up to two bits; those links are verified by the true
    Jaccard similarity of the sets and joined. Then candidates share a band and differ in at most `distance` of all 128
    bits; each pair between different components is verified likewise. In a bucket a node meets its `most` nearest first.
    Where one has more, the bucket is looked at once more, with the sets of these nodes: there all its other candidates of
    other components are verified in place and only links that join two components are passed on. So no candidate between
    two components is passed over, and a group of n texts makes no n * n rows, whether they are alike or just not.

    * null text and texts without words: the empty set, all alike; equal sets are one node;
    * null ids are compared too; repeated rows: each is returned; empty input: no rows. Other columns are not read;
    * very long texts: shingled in blocks; what grows with a text is the set of its hashes, 8 bytes each.
    """
    rows = stash(shingle_sets(docs, words, id_col, text_col, False), "fingerprints")
    nodes = stash(rows.groupBy("node").agg(F.min("f1").alias("f1"), F.min("f2").alias("f2"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "nodes")
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node"))).distinct()
    first = stash(_variant_pairs(nodes, bucket_bound), "pairs")
    found = candidate_pairs(band_rows(nodes.select("bands", "f1", "f2", "node")), distance, most, bucket_bound=bucket_bound)
    pairs = stash(_once(found), "pairs")
    left = stash(found.filter("key IS NOT NULL").select("key", F.col("a").alias("node")).distinct(), "left")
    sets = _sets(docs, nodes.join(ends(pairs.select("a", "b").union(first)).union(left.select("node")).distinct(), "node", "left_semi"), words, id_col, text_col)
    label = components(_alike(first, sets, least))
    nearest = pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("n")).select("n.a", "b")
    label = joined(label, stash(_alike(_across(nearest, label), sets, least), "sure"))
    label = joined(label, stash(_alike(_across(pairs.join(nearest, ["a", "b"], "left_anti"), label), sets, least), "sure"))
    if not left.isEmpty():
        hard = nodes.select("node", "f1", "f2").join(sets, "node").join(label, "node", "left").select("f1", "f2", "node", F.coalesce("component", "node").alias("comp"), "shingles")
        label = joined(label, stash(_joined_buckets(left.join(hard, "node"), distance, least, min(bucket_bound, 5_000)).distinct(), "sure"))
    named = stash(nodes.join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "labels")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(ids, "component").select("node", "component_id"), "node").select(F.col("doc_id").alias(id_col), "component_id")


def _variant_pairs(nodes: DataFrame, bucket_bound: int) -> DataFrame:
    """(a, b): nodes whose fingerprints' first 64 bits are linked by deletion variants, as stars: a node for each fingerprint, with which others of the same bits are paired, too."""
    fps = stash(nodes.groupBy(F.col("f1").alias("fp")).agg(F.min("node").alias("node")), "fps")
    edges = fingerprint_edges(fps.select("fp"), bucket_bound=bucket_bound)
    linked = edges.join(fps.toDF("a", "na"), "a").join(fps.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = nodes.join(fps.toDF("f1", "a"), "f1").select("a", F.col("node").alias("b")).filter("a <> b")
    return linked.union(same)


def _once(found: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    return found.filter("key IS NULL AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("bits").alias("bits"))


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components of label(node, component)."""
    a, b = label.toDF("a", "ca"), label.toDF("b", "cb")
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str, most_sent: int = 200_000) -> DataFrame:
    """(node, shingles) of the nodes: their texts are found by the least id and shingled once more, so that the sets of all other texts are never stored.

    Up to most_sent ids go to all tasks, so that the texts need no shuffle; more of them are joined.
    """
    wanted = stash(nodes.select("node", F.col("least").alias("_least")), "wanted")
    ids = wanted.select("_least").distinct()
    texts = docs.join(F.broadcast(ids) if wanted.count() <= most_sent else ids, F.col(id_col).eqNullSafe(F.col("_least")), "left_semi")
    own = shingle_sets(texts, words, id_col, text_col, True).join(wanted.select("node"), "node", "left_semi")
    return stash(own.dropDuplicates(["node"]).select("node", "shingles"), "sets")
