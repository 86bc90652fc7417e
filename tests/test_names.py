"""Names of documents by their aliases."""

from pyspark.sql import functions as F

from tessera.operators import names


def test_documents_by_number_attachment_issuer_and_extension(spark):
    known = ["460_附件3：资本充足率 计算表.xlsx", "001_银保监会办公厅关于印发_流动性风险管理办法.PPTX", "财政部关于印发金融企业会计准则", "12_notes.txt"]
    asked = {
        "附件3:资本充足率计算表": 0, "资本充足率 计算表": 0, "460_附件3：资本充足率 计算表": 0, "流动性风险管理办法.docx": 1, "银保监会办公厅关于印发_流动性风险管理办法": 1, "金融企业会计准则": 2,
        "12_notes.txt": 3, "12_notes": 3, "notes.txt": 3, "附件4：资本充足率计算表": None, "": None,
    }
    a = spark.createDataFrame(list(enumerate(asked)), "ask_id int, text string")
    n = spark.createDataFrame(list(enumerate(known)), "name_id int, name string")
    got = {r.ask_id: (r.name_id, r.level) for r in names.resolve_documents(a, n).collect()}
    assert {i: got.get(i, (None,))[0] for i in range(len(asked))} == dict(enumerate(asked.values()))
    assert all(got[i][1] == 2 for i in (0, 1, 2, 3, 4, 5)) and got[6][1] == 1


def test_copies_of_names_and_texts_make_no_pairs(spark):
    """Each of 3,000 equal texts meets 3,000 equal names at three levels: 27 million pairs, if copies were expanded."""
    n = spark.range(3000).select(F.col("id").alias("name_id"), F.when(F.col("id") % 2 == 0, "large ring").otherwise("red bolt").alias("name"))
    a = spark.range(3000).select(F.col("id").alias("ask_id"), F.element_at(F.array(*map(F.lit, ("ring_large", "ge ri", "red bolt", "no such name"))), (F.col("id") % 4 + 1).cast("int")).alias("text"))
    found = names.resolve_documents(a, n)
    got = {r.ask_id: (r.name_id, r.level) for r in found.collect()}
    assert got == {i: ((0, 5), (0, 3), (1, 1))[i % 4] for i in range(3000) if i % 4 < 3}
    rows = most_rows(spark, found)
    assert 0 < rows <= 6000


def most_rows(spark, df) -> int:
    """The most rows that any join of the executed plan puts out."""
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    df._jdf.queryExecution().executedPlan().executeCollect()
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
            continue
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return most
