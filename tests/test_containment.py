"""Contained texts against all pairs."""

import random

import pyarrow as pa

from tessera import registry
from tessera.operators import containment, evidence


def test_contained_equals_all_pairs(spark):
    r = random.Random(8)
    long = ["".join(r.choice("abé 😀") for _ in range(r.choice([9, 12, 45, 130, 400, 3000]))) for _ in range(60)]
    texts = [*long, *("".join(r.choice("ab") for _ in range(r.randint(8, 30))) for _ in range(60)), "a" * 5000, "a" * 11, "a" * 10, "a" * 9, None, "", long[0], long[0]]
    for t in long[:50]:
        at, n = r.randrange(len(t)), r.choice([5, 10, 11, 39, 40, 41, 119, 120, 121, 1000])
        texts += [t[at : at + n], t[:n], t[-n:]]
    df = spark.createDataFrame([(t,) for t in texts], "content string").repartition(3)
    some = {t for t in texts if t and len(t) >= 10}
    want = sorted(t for t in some if any(len(o) > len(t) and t in o for o in some))
    assert sorted(x.content for x in containment.contained(df).collect()) == want and len(want) > 50
    assert sorted(x.content for x in containment.contained(df, most_bits=10).collect()) == want  # a table that is full hides nothing
    assert containment.contained(df.limit(0)).count() == 0


def test_only_what_is_asked_for_is_shuffled(spark):
    """Texts of which none is in another: what they keep at all scales is never shuffled, only a key a text and what meets it by chance."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.choice([20, 100, 400, 1500]))) for _ in range(400)]
    assert containment.contained(spark.createDataFrame([(t,) for t in texts], "content string")).count() == 0
    table, bits = containment._table(spark.createDataFrame([(1, 1, i << 50) for i in range(400)], "id long, size int, g long"), containment.MOST_BITS)
    assert len(table) == 1 << (bits - 6)

    class Sent:
        value = table

    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["id", "t"])
    passed = sum(b.num_rows for b in containment._answers(Sent, bits)(iter([batch])))
    assert passed < sum(map(len, texts)) / 20


def test_copies_stay_or_go_together(spark):
    h = spark.createDataFrame([(1, "0123456789 and more"), (2, "0123456789"), (3, "0123456789"), (4, "short"), (5, None)], "idx long, content string")
    assert sorted(x.idx for x in evidence.dedup_contained(h).collect()) == [1, 4, 5]


def moved(spark, run):
    """Bytes that Spark shuffled and wrote while run ran."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    lists = gateway.jvm.java.util.ArrayList

    def stages():
        found = store.stageList(lists(), False, False, gateway.new_array(gateway.jvm.double, 0), lists())
        return [found.apply(i) for i in range(found.size())]

    old = {x.stageId() for x in stages()}
    run()
    new = [x for x in stages() if x.stageId() not in old]
    return sum(x.shuffleWriteBytes() + x.outputBytes() for x in new)


def test_contents_are_neither_shuffled_nor_written(spark, tmp_path):
    """evd2 over long lines, a few of which are inside others: what it shuffles and writes is far less than the lines."""
    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) + "."
    docs = [["x" + line(4000) for _ in range(10)] for _ in range(80)]
    docs += [[d[0], d[1][:2000], d[2][300:340]] for d in docs[:10]]
    spark.createDataFrame([(i, "\n".join(d), "en", "s") for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    size = moved(spark, lambda: got.extend(registry.queries()["evd2_dedup_stages"](spark, str(tmp_path)).collect()))
    assert sorted(x.idx for x in got) == [d * (1 << 32) + i for d in range(80) for i in range(10)]
    assert size < sum(len(x) for d in docs for x in d) / 4


def test_passages_that_many_have_make_no_pairs(spark):
    """Texts that differ at their ends only: none is inside another but one, and only that one meets its container."""
    r = random.Random(6)
    passage = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100))
    texts = [f"{i:x}) {passage} {'!' * (i % 7)}{i}." for i in range(600)]
    texts.append(texts[3] + "?")

    class Sent:
        def __init__(self, value):
            self.value = value

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "t"])
    asked = pa.Table.from_batches(containment._asks(Sent({}))(iter([batch]))).to_pylist()
    keys = [(x["scale"] * len(containment.ASKED) + i, x[c]) for x in asked for i, c in enumerate(containment.ASKED)]
    tables = containment._tables(spark.createDataFrame(keys, "kind int, g long"), containment.MOST_BITS)
    answers = pa.Table.from_batches(containment._answers(Sent(tables))(iter([batch]))).to_pylist()
    assert len(asked) == len(texts)
    assert [(x["id"], y["id"]) for x in asked for y in answers if x["q"] == y["q"] and x["size"] < y["size"]] == [(3, 600)]
    df = spark.createDataFrame([(t,) for t in [*texts, passage]], "content string").repartition(2)
    assert sorted(x.content for x in containment.contained(df).collect()) == sorted([texts[3], passage])
