"""Shapes of chunks and hits: promoted and flattened metadata, traces, explanations, light hits, page of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import present

# Metadata keys that become columns of a stored chunk, and what a missing one becomes.
PROMOTED = {
    "chapter_number": "", "clause_number": "", "subclause_number": "", "applicable_scope": "全部", "normative_level": "neutral",
    "capital_tool_level": "", "table_name": "", "table_section_name": "", "sheet_name": "", "glossary_term": "",
}
# Standard keys of flattened metadata, by level, with what a missing one becomes.
STANDARD = {
    "parser_version": "", "parse_timestamp": "", "source_url": "", "sha256": "", "column": "",
    "attachment_no": "", "applicable_scope": "未指定", "parent_section": "", "chapter_number": "", "clause_number": "",
    "subclause_number": "", "capital_tool_level": "", "context_chunk_id": "",
    "glossary_term": "", "glossary_definition": "", "glossary_term_number": "",
    "normative_level": "neutral", "numeric_conditions": "[]", "keywords": "[]", "cross_attachment_refs": "[]", "cross_table_refs": "[]",
    "table_name": "", "table_full_name": "", "table_section_name": "", "sheet_name": "", "row_count": "0", "col_count": "0", "merge_info": "[]", "cross_refs": "[]",
}
# Keys that are standard too, but are folded into other fields.
FOLDED = ("doc_name", "doc_id", "source_title", "parser_type", "file_type", "block_title")
ANY_SCOPE = ("全部", "未指定", "")


def _key(metadata: Column, key: str, missing: str) -> Column:
    """The key's value, '' where it is null, `missing` where there is no such key."""
    return F.when(F.coalesce(F.map_contains_key(metadata, F.lit(key)), F.lit(False)), F.coalesce(F.element_at(metadata, F.lit(key)), F.lit(""))).otherwise(F.lit(missing))


def _without(metadata: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*keys))


def promote(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """chunks with ten keys of a map of metadata as columns; the map keeps the others. A null map has no keys."""
    m = F.col(metadata)
    return chunks.withColumns({k: _key(m, k, missing) for k, missing in PROMOTED.items()} | {metadata: _without(m, tuple(PROMOTED))})


def flatten(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(chunk_id, chunk_type, content, hierarchy_path, parent_chunk_id, doc columns, standard keys, _extra) of raw chunks.

    content falls back to the path, the parser's type to the file's, the source to the document's name; keys that are no
    standard ones are kept in the map _extra.
    """
    m = F.col(metadata)
    value = lambda k: F.coalesce(F.element_at(m, F.lit(k)), F.lit(""))
    source = present(value("source_title"), value("doc_name"))
    return chunks.select(
        "chunk_id",
        present(F.col("chunk_type"), F.lit("clause")).alias("chunk_type"),
        present(F.col("content"), F.col("hierarchy_path")).alias("content"),
        F.coalesce("hierarchy_path", F.lit("")).alias("hierarchy_path"),
        present(F.col("parent_chunk_id"), value("parent_chunk_id")).alias("parent_chunk_id"),
        source.alias("source_file"),
        value("doc_id").alias("doc_id"),
        value("doc_name").alias("doc_name"),
        source.alias("doc_title"),
        present(value("parser_type"), value("file_type")).alias("parser_type"),
        *(_key(m, k, missing).alias(k) for k, missing in STANDARD.items()),
        _without(m, (*STANDARD, *FOLDED)).alias("_extra"),
    )


def trace(request: dict[str, Column], details: dict[str, Column]) -> Column:
    """Map of what produced a hit: the request's id, strategy, rerank mode and time, then details, which win over equal names. Scores go in as text of 4 digits, fused ones of 6."""
    both = request | details
    return F.create_map(*(x for k, v in both.items() for x in (F.lit(k), v.cast("string"))))


def explain(hits: DataFrame, verbose: bool = False) -> Column:
    """A text for a person: two lines of each hit; verbose: the parts of its score, its trace and the beginning of its content as well."""
    scope = F.coalesce(F.element_at("metadata", F.lit("applicable_scope")), F.lit(""))
    number = F.coalesce(F.element_at("metadata", F.lit("attachment_no")), F.lit(""))
    shown = F.when(scope.isin(*ANY_SCOPE), "").otherwise(F.concat(F.lit(" [适用: "), scope, F.lit("]")))
    where = present(F.col("evidence_snippet"), F.col("hierarchy_path")) if {"evidence_snippet", "hierarchy_path"} <= set(hits.columns) else F.lit("")
    names = F.concat(F.lit("['"), F.array_join("matched_by", "', '"), F.lit("']"))
    head = F.concat(F.format_string("[%d] %s", F.col("rank"), F.col("chunk_type")), F.when(number != "", F.concat(F.lit(" "), number)).otherwise(""), F.lit(" — "), F.col("doc_name"), shown, F.lit(" — "), where)
    lines = [head, F.concat(F.format_string("    score=%.4f  matched_by=", F.col("score")), names, F.lit("  chunk_id="), F.col("chunk_id").cast("string"))]
    if verbose:
        parts = F.transform(F.map_entries("scores_detail"), lambda e: F.format_string("%s=%.4f", e["key"], e["value"]))
        lines.append(F.when(F.size("scores_detail") > 0, F.concat(F.lit("    scores_detail: "), F.array_join(parts, " "))))
        told = F.filter(F.map_entries("trace"), lambda e: ~e["key"].isin("request_id", "strategy", "filters_applied"))
        lines.append(F.when(F.size("trace") > 0, F.concat(F.lit("    trace: "), F.array_join(F.transform(told, lambda e: F.concat_ws("=", e["key"], e["value"])), ", "))))
        lines.append(F.when(F.col("content") != "", F.concat(F.lit("    content: "), F.translate(F.left("content", F.lit(200)), "\n", " "), F.lit("..."))))
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def light(hits: DataFrame, most: int = 300) -> DataFrame:
    """The few fields of a hit that a list shows, content cut to `most` characters."""
    return hits.select("rank", "chunk_id", "chunk_type", present(F.col("doc_name"), F.col("source_file")).alias("doc_name"), F.left("content", F.lit(most)).alias("content"), "citation", "score", "matched_by")


def for_tools(hits: DataFrame, most: int = 500) -> DataFrame:
    """A hit as a tool returns it: content cut to `most` characters (0: whole) and five fields of its metadata, '' where missing."""
    m = F.col("metadata")
    fields = (F.coalesce(F.element_at(m, F.lit(k)), F.lit("")).alias(k) for k in ("applicable_scope", "attachment_no", "clause_number", "table_name", "sheet_name"))
    content = F.left("content", F.lit(most)) if most > 0 else F.col("content")
    return hits.select("rank", "chunk_id", "chunk_type", present(F.col("doc_name"), F.col("source_file")).alias("doc_name"), content.alias("content"), "score", *fields)


def page(rows: DataFrame, order: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a list: limit is held between 1 and 200, offset at 0 or more."""
    return rows.orderBy(order).offset(max(0, offset)).limit(min(max(1, limit), 200))
