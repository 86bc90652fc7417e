"""Many names in many texts: a trie with failure links, built once a worker, reads each text once and finds all of them.

Names go to the tasks in blocks of bounded size; more names than one block holds are further passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from tessera.functions import rules, shipped
from tessera.functions.scalars import each
from tessera.operators.retrieval import spread
from tessera.sources.rounds import settle

#: Characters of the names that go to every task at once.
BLOCK_CHARS = 4_000_000

_BUILT: dict[int, object] = {}


def _automaton(sent):
    """The automaton of a block of names; a worker keeps the one it used last."""
    if sent.key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        found = ahocorasick.Automaton()
        for name in sent.names.value:
            found.add_word(name, name)
        found.make_automaton()
        _BUILT[sent.key] = found
    return _BUILT[sent.key]


class _Sent:
    def __init__(self, names, key: str):
        self.names, self.key = names, key


def _found(sent: _Sent, ids: int, most_rows: int = 50_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _automaton(sent)
        for b in batches:
            row, name, first, n = [], [], [], []

            def out(b=b):
                at = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(ids)), pa.array(name), pa.array(first, pa.int32()), pa.array(n, pa.int64())], names=[*b.schema.names[:ids], "name", "first", "n"])

            for i, text in enumerate(b.column(ids)):
                text, met = text.as_py(), {}
                for end, what in names.iter(text) if text else ():
                    if what in met:
                        met[what][1] += 1
                    else:
                        met[what] = [end - len(what) + 1, 1]
                for what, (at, times) in met.items():
                    row.append(i)
                    name.append(what)
                    first.append(at)
                    n.append(times)
                if len(row) > most_rows:
                    yield out()
                    row, name, first, n = [], [], [], []
            if row:
                yield out()

    return run


def occurrences(texts: DataFrame, ids: list[str], text: str, names: DataFrame, name: str = "name", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(ids, name, first, n): each name that a text contains, where it begins first (from 0) and how often it occurs, overlaps included.

    Upper and lower case differ. Null or empty texts contain nothing, null or empty names are nowhere, repeated names are
    one; repeated rows are read each. The names' size is measured; those of one block (by hash) are sent together, so any
    number of names is found, in as many passes over the texts.
    """
    spark = texts.sparkSession
    own = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    chars = own.agg(F.sum(F.length("name"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    schema = StructType(list(texts.select(*ids).schema.fields)).add("name", StringType()).add("first", IntegerType()).add("n", LongType())
    read, out = spread(texts.select(*ids, F.col(text).alias("_text"))), None
    for i in range(blocks):
        block = own.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i) if blocks > 1 else own
        sent = spark.sparkContext.broadcast([r[0] for r in block.collect()])
        if not sent.value:
            continue
        met = read.mapInArrow(_found(_Sent(sent, f"{spark.sparkContext.applicationId} {sent._jbroadcast.id()}"), len(ids)), schema)
        out = met if out is None else out.unionByName(met)
    return spark.createDataFrame([], schema) if out is None else out


def contained(names: DataFrame, name: str = "name", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(outer, inner): pairs of different names, the second of which occurs in the first."""
    own = names.select(F.col(name).alias("outer")).filter("outer <> ''").distinct()
    met = occurrences(own, ["outer"], "outer", own, "outer", block_chars)
    return met.filter("outer <> name").select("outer", F.col("name").alias("inner"))


def longest(found: DataFrame, ids: list[str], names: DataFrame, name: str = "name", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of found (ids, name, ...) whose name is in no longer name found for the same ids.

    Every found name is joined with the names inside it, of which it has few, and these are taken out.
    """
    inside = found.select(*ids, F.col("name").alias("outer")).join(contained(names, name, block_chars), "outer")
    inside = inside.select(*ids, F.col("inner").alias("name")).distinct()
    same = [found[c].eqNullSafe(inside[c]) for c in [*ids, "name"]]
    return found.join(inside, same, "left_anti")


def expand(texts: DataFrame, ids: list[str], text: str, groups: DataFrame, out: str = "expanded", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(ids, out): each text, followed by the other names of the groups whose names it contains, if it lacks them.

    groups(group_id, nth, name): names of one meaning, in order. Of the names found only the longest count; they are taken
    in the order of their places, each one's others in the group's order, and nothing is added twice. A name of several
    groups belongs to the last. ids name a text.
    """
    of = groups.groupBy("name").agg(F.max("group_id").alias("group_id"))
    met = settle(occurrences(texts, ids, text, groups, block_chars=block_chars))  # read three times
    kept = longest(met, ids, groups, block_chars=block_chars).join(of, "name").select(*ids, "first", "group_id", F.col("name").alias("had"))
    more = kept.join(groups, "group_id").filter("name <> had").groupBy(*ids, "name").agg(F.min(F.struct("first", "nth")).alias("place"))
    lacks = more.join(met.select(*ids, "name"), [more[c].eqNullSafe(met[c]) for c in [*ids, "name"]], "left_anti")
    added = lacks.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("added"))
    own = texts.select(*ids, F.col(text).alias(out))
    joined = own.join(added, [own[c].eqNullSafe(added[c]) for c in ids], "left").select(*(own[c] for c in ids), out, "added")
    return joined.select(*ids, F.concat_ws(" ", F.array(out), F.col("added.name")).alias(out))


def entities(texts: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, kind, value, confidence): entities by the shipped patterns, gazetteers and terms, each kind and value once, by its highest confidence.

    Null or blank texts have none. ids name a text; rows that share them are taken together.
    """
    whole = texts.select(*ids, F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("_whole"))
    said = each(whole, rules.patterned(F.col("_whole")), "e", *ids).select(*ids, "e.kind", "e.value", "e.confidence")
    rows = [(name, kind, sure) for kind, sure, names in shipped.GAZETTEERS for name in names]
    known = texts.sparkSession.createDataFrame(rows, "name string, kind string, confidence double")
    named = occurrences(whole, ids, "_whole", known).join(F.broadcast(known), "name")  # a fixed table
    every = said.unionByName(named.select(*ids, "kind", F.col("name").alias("value"), "confidence"))
    return every.groupBy(*ids, "kind", "value").agg(F.max("confidence").alias("confidence"))
