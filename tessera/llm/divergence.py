"""Divergence audit: how far each source's words lie from those of every other source of its language.

Terms with the same counts in the same sources add the same to every pair of sources. So terms are grouped by their sparse
vector of counts, each pair of the vector's sources is evaluated once a distinct vector, and the value is multiplied by the
number of its terms. What a source without the term adds needs no vector: with f(s, t) for both sources' probabilities,
0 marking the probability of a term with no count,

    sum f(s, t) = V f(0, 0) + sum over s's counts (f(s, 0) - f(0, 0)) + sum over t's counts (f(0, t) - f(0, 0))
                  + sum over the vectors with both (f(s, t) - f(s, 0) - f(0, t) + f(0, 0)).

The last sum takes the pairs inside vectors, the two before it only how many terms a source has of each count. All values are
whole numbers: probabilities are billionths, rounded down, and every sum is at most (10^9 + V)^2, which fits 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash, text_of

WHOLE = 1_000_000_000
#: Bytes that end a term, as spaces, and A-Z in lower case.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Counts of terms, and pairs of entries or of sources, that a task holds before it passes them on.
HELD_TERMS, HELD_PAIRS = 500_000, 1_000_000


def _count_terms(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), combined over documents until there are more than `held`."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in counts.items():
            terms = list(times)
            for i in range(0, len(terms), 100_000):
                some = terms[i : i + 100_000]
                arrays = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode() for t in some])]
                arrays += [pa.array([c[t] for t in some], pa.int64()) for c in (times, docs)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "times", "docs"])
        counts.clear()

    for b in batches:
        for text, lang, source in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            times, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            found = text.as_py().translate(FOLD).split()
            times.update(found)
            docs.update(set(found))
        if sum(len(times) for times, _ in counts.values()) > held:
            yield from out()
    yield from out()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exactly."""
    above = (count + 1).cast("decimal(19,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    below = (total + kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, below)).otherwise(0)


def _far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs_of_vectors(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """What the pairs of sources inside distinct vectors add beyond their sources alone, summed over a task's vectors."""
    sums: dict[tuple[str, str, str], int] = {}
    far = lambda p, q: (p - q) * (p - q) // q

    def out() -> pa.RecordBatch:
        langs, s, t = zip(*sums, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(s), pa.array(t), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "both"])
        sums.clear()
        return batch

    for b in batches:
        of = {n: b.column(n) for n in ("lang", "vector", "p", "p0")}
        times, size = b.column("times").to_numpy(), np.diff(of["vector"].offsets.to_numpy())
        codes = of["vector"].flatten().field("source").dictionary_encode()
        names, source = codes.dictionary.to_pylist(), codes.indices.to_numpy().astype(np.int64)
        p, p0 = (of[c].flatten().to_numpy() for c in ("p", "p0"))
        lang = of["lang"].dictionary_encode()
        tongue = np.repeat(lang.indices.to_numpy().astype(np.int64), size)
        first, weight, n = np.repeat(np.cumsum(size) - size, size), np.repeat(times, size), len(names)
        lo = 0
        width = np.repeat(size, size).astype(np.int64)  # partners of each entry, itself included
        upto = np.cumsum(width)
        while lo < len(width):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + held, "right")))
            w = width[lo:hi]
            left = np.repeat(np.arange(lo, hi), w)
            right = np.repeat(first[lo:hi] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            apart = left != right
            left, right = left[apart], right[apart]
            more = far(p[left], p[right]) - far(p[left], p0[right]) - far(p0[left], p[right]) + far(p0[left], p0[right])
            keys, at = np.unique((tongue[left] * n + source[left]) * n + source[right], return_inverse=True)
            added = np.zeros(len(keys), np.int64)
            np.add.at(added, at, more * weight[left])
            for key, v in zip(keys.tolist(), added.tolist(), strict=True):
                name = lang.dictionary[key // (n * n)].as_py(), names[key // n % n], names[key % n]
                sums[name] = sums.get(name, 0) + v
            lo = hi
            if len(sums) > held:
                yield out()
    if sums:
        yield out()


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", rank)
    rows = rows.filter(F.col("rank") <= most) if most else rows
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, held: tuple[int, int] = (HELD_TERMS, HELD_PAIRS)) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every other source by divergence (`pair`), and the terms that drive it (`term`).

    * null text, lang or source: the empty string; a source without any kept term is a group with no counts;
    * a language without kept terms: value 0 for all its pairs, no terms;
    * very long texts count whole; repeated rows: each; ties in value: by item in UTF-8;
    * empty input: no rows. Other columns are not read.

    Every language gets a row for each ordered pair of its sources, which is also the bound of a vector: a term's counts by
    source. Everything else is combined before it is shuffled.
    """
    rows = docs.select(text_of(text_col).alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))
    groups = rows.select("lang", "source").distinct()
    counts = rows.mapInArrow(partial(_count_terms, held=held[0]), "lang string, source string, term string, times long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    vectors = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("times").alias("all_times"), F.array_sort(F.collect_list(F.struct("source", "times"))).alias("vector")
    )
    kept = stash(vectors.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")

    distinct = stash(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")), "vectors")
    entries = distinct.select("lang", F.col("times").alias("n"), F.explode("vector").alias("e")).select("lang", "e.source", F.col("e.times").alias("c"), "n")
    by_count = entries.groupBy("lang", "source", "c").agg(F.sum("n").alias("n"))
    by_count = stash(by_count, "counts-of-counts")
    totals = by_count.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("n")).alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_times").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = stash(groups.withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")

    # Sources alone: how many terms of each probability a source has, against each other source's probability of no count.
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = by_count.join(groups, ["lang", "source"]).select("lang", "source", "p0", "n", _share(F.col("c"), F.col("total"), F.col("v")).alias("p"))
    alone = alone.join(other, "lang").filter("source != item")
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    alone = alone.groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * (_far(p, q0) - _far(p0, q0))).alias("first"), F.sum(F.col("n") * (_far(q0, p) - _far(q0, p0))).alias("second")
    )
    # Pairs inside vectors, each with its sources' probabilities.
    inside = distinct.filter(F.size("vector") > 1).withColumn("vector_id", F.monotonically_increasing_id())
    inside = stash(inside, "vectors-inside")
    spread = inside.select("lang", "vector_id", "times", F.posexplode("vector").alias("at", "e")).select("lang", "vector_id", "times", "at", "e.source", F.col("e.times").alias("c"))
    spread = spread.join(groups, ["lang", "source"]).select("lang", "vector_id", "times", "at", "source", _share(F.col("c"), F.col("total"), F.col("v")).alias("p"), "p0")
    spread = spread.groupBy("lang", "vector_id", "times").agg(F.array_sort(F.collect_list(F.struct("at", "source", "p", "p0"))).alias("v"))
    both = spread.select("lang", "times", F.transform("v", lambda x: F.struct(x["source"].alias("source"))).alias("vector"), F.col("v.p").alias("p"), F.col("v.p0").alias("p0"))
    both = both.mapInArrow(partial(_pairs_of_vectors, held=held[1]), "lang string, source string, item string, both long").groupBy("lang", "source", "item").agg(F.sum("both").alias("both"))

    swapped = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "second")
    pairs = groups.join(other, "lang").filter("source != item")
    pairs = pairs.join(alone.select("lang", "source", "item", "first"), ["lang", "source", "item"], "left").join(swapped, ["lang", "source", "item"], "left")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").na.fill(0, ["first", "second", "both"])
    value = F.when(F.col("v") > 0, F.col("v") * _far(p0, q0) + F.col("first") + F.col("second") + F.col("both")).otherwise(F.lit(0)).cast("long")
    pairs = pairs.select("lang", "source", "item", value.alias("value"))

    terms = kept.select("lang", F.col("term").alias("item"), "all_times", F.explode("vector").alias("e")).select("lang", "e.source", "item", "all_times", F.col("e.times").alias("c"))
    terms = terms.join(groups, ["lang", "source"]).select(
        "lang", "source", "item", _share(F.col("c"), F.col("total"), F.col("v")).alias("p"), _share(F.col("all_times"), F.col("lang_total"), F.col("v")).alias("q")
    )
    terms = terms.filter("p > q").select("lang", "source", "item", _far(p, q).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term", top))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM c GROUP BY lang, source),
m AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(c) AS HUGEINT) AS n FROM k GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + m.v) AS p,
             1 + (1000000000::HUGEINT * (k.c + 1)) // (m.n + m.v) AS q
      FROM g JOIN k USING (lang) JOIN m USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
