"""Gazetteers against plain loops, the shipped rules against what they must find."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import rules, shipped
from tessera.operators import gazetteer, joins, names
from tessera.plans import mentions

NAMES = ["a", "ab", "abab", "b", "é", "éa", "zz", "abc", "", None, "ab"]


def places(text, name):
    return [i for i in range(len(text) - len(name) + 1) if text[i : i + len(name)] == name]


@pytest.mark.parametrize("block", [4_000_000, 3])
def test_occurrences_equal_loops(spark, block):
    r = random.Random(7)
    rows = [(i, "".join(r.choice("abcéz😀") for _ in range(r.randint(0, 12)))) for i in range(80)] + [(80, None), (81, ""), (82, "ab" * 30_000), (None, "ab"), (83, "aab"), (83, "zz")]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("name", F.lit("clash"))
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = gazetteer.occurrences(texts.repartition(3), ["id"], "text", names, block_chars=block)
    # Places are code points, as in Spark's own functions.
    plain = sorted(((i, n, places(t, n)[0], len(places(t, n))) for i, t in rows if t for n in {x for x in NAMES if x} if places(t, n)), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == plain
    kept = gazetteer.longest(found, ["id"], names, block_chars=block)
    of = {}
    for i, n, *_ in plain:
        of.setdefault(i, set()).add(n)
    assert sorted(((x.id, x.name) for x in kept.collect()), key=repr) == sorted(((i, n) for i, n, *_ in plain if not any(n != o and n in o for o in of[i])), key=repr)
    assert gazetteer.occurrences(texts, ["id"], "text", names.limit(0)).count() == 0


def test_expand_takes_the_order_of_mention(spark):
    groups = spark.createDataFrame([(0, 0, "资本充足率"), (0, 1, "CAR"), (1, 0, "核心一级资本充足率"), (1, 1, "CET1"), (2, 0, "杠杆率"), (2, 1, "Leverage Ratio")], "group_id int, nth int, name string")
    rows = [(1, "CAR最低多少"), (2, "杠杆率和核心一级资本充足率"), (3, "第43条内容"), (4, "资本充足率 CAR"), (5, None), (6, "")]
    got = {r.id: r.expanded for r in gazetteer.expand(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", groups).collect()}
    assert got[1] == "CAR最低多少 资本充足率" and got[2] == "杠杆率和核心一级资本充足率 Leverage Ratio CET1" and got[3] == "第43条内容" and got[4] == "资本充足率 CAR" and got[6] == ""


def test_questions_meet_every_shipped_rule(spark):
    asked = mentions.questions(spark, "/root/testdata/sf0.01").cache()
    hit = asked.select(F.explode(F.array(*(F.when(F.col("text").rlike(f"(?Ui){rx}"), i) for i, (_, rx, _) in enumerate(shipped.INTENTS)))).alias("i")).filter("i IS NOT NULL").distinct().count()
    assert hit == len(shipped.INTENTS)
    kinds = {r.kind for r in gazetteer.entities(asked, ["conv_id", "turn", "role"], "text").select("kind").distinct().collect()}
    assert kinds == {*(p[0] for p in shipped.PATTERNS), *(g[0] for g in shipped.GAZETTEERS), "term"}


@pytest.mark.parametrize(("text", "intent", "confidence"), [
    ("你好", "greeting", 0.95), ("  Hello ! ", "greeting", 0.95), ("《商业银行资本管理办法》第四十三条的内容", "clause_query", 0.95), ("什么是资本充足率？", "definition", 0.85), ("天气", "unknown", 0.3),
    ("", "unknown", 0.0), (None, "unknown", 0.0), ("A vs B 最低", "threshold", 0.7225),
])
def test_intents(spark, text, intent, confidence):
    got = spark.createDataFrame([(text,)], "t string").select(rules.intent_of(F.col("t")).alias("i")).first().i
    assert (got.intent, got.confidence) == (intent, confidence)


def test_scopes_of_many_classes(spark):
    scopes = ["all banks", "banks", "BANKS", "large banks", "x", "", None]
    rows = [(d, scopes[d % 7]) for d in range(14)]
    got = joins.overlapping_scopes(spark.createDataFrame(rows, "doc long, scope string"), "doc", "scope")
    named = [s for s in scopes if s]
    assert sorted((r.scope, r.inside) for r in got.collect()) == sorted((a, b) for a in named for b in named if b.lower() in a.lower())


def test_table_names_equal_all_pairs(spark):
    """The pieces that names meet on lose no pair that the rules accept."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abc年2") for _ in range(r.randint(1, 11)))
    asked, known = [(i, word()) for i in range(60)], sorted({word() for _ in range(40)})
    plain = []
    for i, a in asked:
        best = []
        whole = max((min(len(a), len(t)) / max(len(a), len(t)) for t in known if a in t or t in a), default=0.0)
        for t in known:
            share = min(len(a), len(t)) / max(len(a), len(t)) if a in t or t in a else 0.0
            common = names.longest_common(a, t) / min(len(a), len(t)) if whole < 0.5 else 0.0
            if a == t:
                best.append((1, -1.0, t, 1))
            elif max(share, common) > 0.4:
                best.append((3, -max(share, common), t, 3 if share >= common else 4))
        if best:
            _, score, t, level = min(best)
            plain.append((i, t, level, round(-score, 6)))
    got = names.resolve_tables(spark.createDataFrame(asked, "ask_id long, text string"), spark.createDataFrame([(t,) for t in known], "name string"))
    assert sorted((x.ask_id, x.name, x.level, x.score) for x in got.collect()) == sorted(plain)


def test_terms_of_long_lines_take_no_time_with_the_square(spark):
    import re

    from tessera.functions import rules

    odd = ["", "是指", "是指是指", "a是指是指b是指", "x\ny是指\r\n是指z是指", "没有", "a是指\n\n是指 b", "储备是指c\u2028d是指"]
    long = "字" * 100_000
    rows = [*odd, f"储备是指{long}", long + "是指"]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", rules.patterned(F.col("t")).alias("p")).collect()
    line = lambda t: [x.strip() for part in re.split("[\n\r\x85\u2028\u2029]", t) for x in re.findall("(.+?)是指", part)]
    for r in got:
        want = ["储备"] if r.i == len(odd) else [] if r.i > len(odd) else [x for x in line(rows[r.i]) if x]
        assert [p.value for p in r.p if p.kind == "term"] == want, rows[r.i][:40]


def test_found_names_are_read_once(spark):
    from tessera.plans.mentions import qu2_gazetteer

    assert "MapInArrow run(doc_id" not in qu2_gazetteer(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_made_once_for_bundles(spark):
    plan = mentions.jn7_bundles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_links_are_made_once_for_walks(spark):
    plan = mentions.jn6_walk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
