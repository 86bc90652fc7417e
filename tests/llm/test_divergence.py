"""Divergence audit against SQL and against loops over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import same_as_sql

from tessera.llm import divergence


def plain(rows, least, top):
    times, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        times[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = [s for x, s in groups if x == lang]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = shares(times[lang, source])
        far = lambda p, q: (p - q) * (p - q) // q
        pairs = []
        for item in own:
            if item != source:
                q = shares(times[lang, item])
                pairs.append((-sum(far(p[t], q[t]) for t in kept), item.encode(), item))
        whole = shares(sum((times[lang, s] for s in own), Counter()))
        terms = [(-far(p[t], whole[t]), t.encode(), t) for t in kept if times[lang, source][t] and p[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, x[2], -x[0], i + 1) for i, x in enumerate(sorted(found)[:most])]
    return sorted(out)


def test_divergence_query_equals_sql(spark):
    same_as_sql(spark, "op12_divergence", ["documents"])


@pytest.mark.parametrize(("seed", "held"), [(1, (500_000, 1_000_000)), (2, (3, 3)), (3, (1, 1))])
def test_divergence_equals_loops(spark, seed, held):
    r = random.Random(seed)
    words = [*"abcdefgh", "É", "ñÑ", "ABC", "x1y", "'", "藏", "😀z"]
    rows = [(" ".join(r.choice(words[: r.randint(1, len(words))]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "é", "Z", None, ""])) for _ in range(150)]
    rows += [(None, "en", "void"), ("", "xx", "a"), ("only once", "xx", "b"), ("rare rare", "yy", "a"), ("a " * 50_000, "en", "s1")] + [("copy of one", "en", "hot")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("clash"), "times": F.lit(1), "docs": F.lit(2)})
    got = divergence.audit(docs.repartition(3), top=5, held=held)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 5)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
