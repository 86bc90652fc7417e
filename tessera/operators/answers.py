"""Answers before they are written: claim slots of a question, the answer's plan, citations, filters from entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import present

# Fixed values: (slot, description, required) of each template, and of the one for all other intents.
SLOTS = {
    "threshold": (
        ("applicable_entity", "适用主体", True), ("metric_name", "指标名称", True), ("minimum_value", "最低比例/数值", True),
        ("effective_date", "生效时间", True), ("exceptions", "例外或附加要求", False), ("legal_basis", "法规依据", True),
    ),
    "definition": (("term", "被定义术语", True), ("definition", "定义内容", True), ("source", "定义来源", True)),
    "table_lookup": (
        ("table_name", "表名", True), ("row_key", "行标题", True), ("column_key", "列标题/期间", True),
        ("value", "单元格值", True), ("unit", "单位", False), ("source", "来源文件和页码", True),
    ),
    "clause_query": (("clause_content", "条款内容", True), ("clause_no", "条款编号", True), ("source", "来源文件", True), ("normative_level", "规范强度", False)),
    "comparison": (
        ("entity_a", "比较对象A", True), ("entity_b", "比较对象B", True), ("dimensions", "比较维度", True),
        ("differences", "差异点", True), ("sources", "双方来源", True),
    ),
}
GENERIC = (("main_answer", "主要回答内容", True), ("source", "来源依据", True))
# Intents that use the template of another name.
TEMPLATE_OF = {"threshold_query": "threshold", "definition_query": "definition"}
# The sections of an answer and its shape, by intent; others take those of "unknown".
SECTIONS = {
    "clause_query": ("法条原文", "适用范围", "规范强度"),
    "threshold": ("指标名称", "最低/最高要求", "适用主体", "生效时间", "法规依据"),
    "definition": ("定义内容", "适用范围", "来源"),
    "table_lookup": ("查询结果", "数据来源"),
    "comparison": ("对比维度", "对象A", "对象B", "结论"),
    "compliance": ("合规判断", "适用条款", "结论"),
    "overview": ("概述", "要点", "来源"),
    "unknown": ("相关内容", "来源"),
}
SHAPES = {"table_lookup": "table_data", "comparison": "comparison", "compliance": "compliance_judgment"}
PLAIN_SHAPE, MOST_CITED = "text_excerpt", 5
# Kinds of chunks that are cited by attachment, table and row.
TABLE_KINDS = ("table", "attachment_table", "form")
# How an entity's value reads as a filter on its field.
FILTERS = {"doc_name": "%s", "clause_number": "第%s条", "chapter_number": "第%s章", "table_name": "%s", "attachment_no": "附件%s"}


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def claim_slots(questions: DataFrame, by: str, intent: str = "intent", template: str | None = None, templates: dict[str, tuple] | None = None) -> DataFrame:
    """(by, n, slot, description, required): a row for each slot of a question's template, in its order.

    A column `template` names one directly and goes before the intent if there is such a template; templates adds to the
    shipped ones or takes their place. Intents without a template, null ones too, take the generic one.
    """
    known = SLOTS | (templates or {})
    kind = "array<struct<slot:string,description:string,required:boolean>>"
    array = lambda some: F.array(*(F.struct(*map(F.lit, s)) for s in some)).cast(kind)
    table = F.create_map(*(x for k, some in known.items() for x in (F.lit(k), array(some))))
    own = F.coalesce(F.element_at(_literal_map(TEMPLATE_OF), F.col(intent)), F.col(intent))
    found = F.element_at(table, own)
    if template:
        found = F.coalesce(F.element_at(table, F.col(template)), found)
    rows = questions.select(by, F.posexplode(F.coalesce(found, array(GENERIC))).alias("n", "s"))
    return rows.select(by, "n", "s.*")


def answer_plans(questions: DataFrame, evidence: DataFrame, by: str, intent: str = "intent") -> DataFrame:
    """(by, sections, shape, evidence_order, n_required) of questions(by, intent) and evidence(by, evidence_id, score, idx).

    Evidence goes by score, best first, ties as given (idx); five citations at most are required. Evidence of a question
    is what its retrieval kept, some dozen rows.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("idx"), F.col("evidence_id")))), lambda x: x["evidence_id"])
    ordered = evidence.groupBy(by).agg(order.alias("evidence_order"))
    sections = F.create_map(*(x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    out = questions.join(ordered, by, "left")
    n = F.coalesce(F.size("evidence_order"), F.lit(0))
    return out.select(
        by,
        F.coalesce(F.element_at(sections, F.col(intent)), F.element_at(sections, F.lit("unknown"))).alias("sections"),
        F.coalesce(F.element_at(_literal_map(SHAPES), F.col(intent)), F.lit(PLAIN_SHAPE)).alias("shape"),
        F.coalesce("evidence_order", F.array()).alias("evidence_order"),
        F.least(F.greatest(n, F.lit(0)), F.lit(MOST_CITED)).alias("n_required"),
    )


def citation(kind: Column, doc: Column, metadata: Column, existing: Column) -> Column:
    """A chunk's citation: 《doc》第n条 by its clause, else its page, else a clause in the existing citation, else that one.

    Chunks of tables are cited by attachment, table and row, each from the metadata or the existing citation.
    """
    value = lambda *keys: present(*(F.element_at(metadata, F.lit(k)) for k in keys))
    told = F.coalesce(existing, F.lit(""))
    named = F.concat(F.lit("《"), F.when(present(doc, value("doc_name")) != "", present(doc, value("doc_name"))).otherwise("相关法规"), F.lit("》"))
    place = lambda n, sign: F.when(n != "", F.concat(named, F.lit("第"), n, F.lit(sign)))
    formed = F.contains(told, F.lit("《")) | F.contains(told, F.lit("第")) | F.contains(told, F.lit("附件"))
    clause = F.coalesce(
        place(value("clause_number", "article_number"), "条"),
        place(value("page_number"), "页"),
        place(F.regexp_extract(told, r"第\s*([一二三四五六七八九十百千\d]+)\s*条", 1), "条"),
        F.when(formed, told),
        F.concat(named, told),
    )
    parts = (("附件", "", ("attachment_number", "attachment_num"), r"附件\s*(\d+)"), ("表", "", ("table_number", "table_num"), r"表\s*(\d+)"), ("第", "行", ("row_number", "row_num"), r"第\s*(\d+)\s*行"))
    found = [(a, z, present(value(*keys), F.regexp_extract(told, rx, 1))) for a, z, keys, rx in parts]
    cells = F.array_join(F.array_compact(F.array(*(F.when(n != "", F.concat(F.lit(a), n, F.lit(z))) for a, z, n in found))), " ")
    source = present(doc)
    in_table = F.coalesce(F.nullif(cells, F.lit("")), F.nullif(told, F.lit("")), F.nullif(source, F.lit("")), F.lit("表格数据"))
    return F.when(F.lower(F.coalesce(kind, F.lit(""))).isin(*TABLE_KINDS), in_table).otherwise(clause)


def question_filters(entities: Column, scope: Column) -> Column:
    """map field -> value of a question's entities (kind, value) and scope; of several values of a kind the last one counts."""
    known = F.filter(F.coalesce(entities, F.array().cast("array<struct<kind:string,value:string>>")), lambda e: e["kind"].isin(*FILTERS) & (F.coalesce(e["value"], F.lit("")) != ""))
    last = lambda kind: F.try_element_at(F.filter(known, lambda e: e["kind"] == kind), F.lit(-1))["value"]
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.format_string(FILTERS[k], v).alias("value"))) for k, v in ((k, last(k)) for k in FILTERS)]
    own = F.when(F.coalesce(scope, F.lit("")) != "", F.struct(F.lit("applicable_scope").alias("key"), scope.alias("value")))
    return F.map_from_entries(F.array_compact(F.array(own, *pairs)))


def urgent_first(rows: DataFrame, priority: str = "priority", order: str = "idx") -> DataFrame:
    """Rows by priority, those of one priority in the order given."""
    return rows.orderBy(priority, order)
