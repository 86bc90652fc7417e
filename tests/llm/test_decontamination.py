"""Decontamination against SQL and against a plain loop over windows."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, queries

from test_llm import same_as_sql

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, items, window):
    held = {}
    for i, text in items:
        w = words(text)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            held.setdefault(tuple(w[s : s + window]), set()).add("" if i is None else str(i))
    sizes, out = {len(w) for w in held}, []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in held:
                    hit.update(range(s, s + n))
                    found |= held[key]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_decontamination_query_equals_sql(spark):
    same_as_sql(spark, "op13_decontamination", ["documents", "benchmark"])


@pytest.mark.parametrize(("window", "shingle", "sent"), [(10, 5, 200_000), (10, 5, 0), (7, 3, 200_000), (3, 1, 0), (13, 4, 200_000)])
def test_decontamination_equals_loops(spark, window, shingle, sent):
    r = random.Random(window)
    pick = lambda n, of="ab": " ".join(r.choice(of) for _ in range(n))
    items = [(i, pick(r.randint(0, 16), ["a", "b", "É", "x1"])) for i in range(40)] + [(40, None), (41, "..."), (None, pick(12)), (42, "Solo"), (43, "Two, WORDS"), (43, "two words"), (10, "a b")]
    docs = [(i, pick(r.randint(0, 60), ["a", "A", "b,", "É", "x1", "solo"])) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "two  words"), (102, "it is SOLO"), (102, "it is SOLO"), (103, pick(30_000)), (104, "two-words"), (105, "\x00two\x7fwords\x1f")]
    docs += [(200 + i, docs[5][1]) for i in range(30)]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"content": F.lit("clash"), "sid": F.lit(1), "item_id": F.lit(2)})
    right = spark.createDataFrame(items, "item_id long, text string").withColumns({"words": F.lit("clash"), "size": F.lit(1)})
    got = decontamination.decontaminate(left.repartition(3), right, window=window, shingle=shingle, sent=sent)
    assert rows_of(got) == plain(docs, items, window)


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontamination.decontaminate(docs, items)) == plain([(1, "a b")], [], 10)
    assert decontamination.decontaminate(docs.limit(0), items.union(spark.createDataFrame([(1, "a")], items.schema))).count() == 0
