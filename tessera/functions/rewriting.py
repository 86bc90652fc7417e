"""Questions rewritten: references resolved against a session, queries for each channel, the specification of a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.questions import expanded

# Words that refer to what was said before, by what they refer to; the first kind that matches counts.
REFERENCES = (
    ("metric", "这个比例|这个指标|这个比率|那个比例|那个指标|那个比率|该比例|该指标|该比率|此比例|此指标|此比率|这个数|这个值|那个数|那个值"),
    ("doc", "那个文件|那个规定|那个制度|那部法规|那部法律|该文件|该规定|该制度|该法规|这个文件|这个规定|这个制度|此文件|此规定|此制度"),
    ("clause", "那条|该条|这个条款|那个条款|该条款|此条|此条款"),
    ("topic", "之前提到的|之前说的|刚才提到的|刚才说的|上面提到的|上面说的|前文提到的|前面提到的"),
)
CLAUSE, DOCUMENT = r"第[一二三四五六七八九十百千零\d]+条", r"《[^》]+》"
KEY_KINDS = ("metric_name", "doc_name", "clause_number")
# Complexity and base risk of each intent, the channels it needs and the form of its answer.
COMPLEXITY = {"greeting": "L0", "clause_query": "L1", "definition": "L2", "threshold": "L2", "table_lookup": "L2", "overview": "L2", "comparison": "L3", "compliance": "L4"}
LEVELS = ("L0", "L1", "L2", "L3", "L4")

TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(TEXTS)


def reference(text: Column) -> Column:
    """struct(kind, word) of the first reference in a text; null where there is none."""
    cases = None
    for kind, rx in REFERENCES:
        word = F.regexp_extract(text, rx, 0)
        hit = F.struct(F.lit(kind).alias("kind"), word.alias("word"))
        cases = F.when(word != "", hit) if cases is None else cases.when(word != "", hit)
    return cases


def candidates(kind: Column, metrics: Column, docs: Column, entities: Column, history: Column) -> Column:
    """What a reference of a kind may mean, each once in the order of mention.

    metrics and docs are names a session has mentioned, entities structs (kind, value) found in earlier questions, history
    the earlier questions themselves, in which clauses are looked for.
    """
    of = lambda k: F.transform(F.filter(F.coalesce(entities, F.array().cast("array<struct<kind:string,value:string>>")), lambda e: e["kind"] == k), lambda e: e["value"])
    metrics, docs = F.coalesce(metrics, _none()), F.coalesce(docs, _none())
    clauses = F.flatten(F.transform(F.coalesce(history, _none()), lambda q: F.regexp_extract_all(q, F.lit(CLAUSE), F.lit(0))))
    some = F.when(kind == "metric", F.concat(metrics, of("metric_name"))).when(kind == "doc", F.concat(docs, of("doc_name"))).when(kind == "clause", clauses)
    some = some.when(kind == "topic", F.concat(metrics, docs, of("metric_name"), of("doc_name"))).otherwise(_none())
    return F.filter(F.array_distinct(some), lambda c: F.coalesce(c, F.lit("")) != "")


def resolved(text: Column, metrics: Column, docs: Column, entities: Column, history: Column) -> Column:
    """struct(text, resolved, ambiguous, kind): the first reference replaced by what it means, if that is one thing.

    Nothing, or several things, that it may mean: the text stays and is flagged. Without a reference nothing happens.
    """
    ref = reference(F.trim(text))
    some = candidates(ref["kind"], metrics, docs, entities, history)
    one = ref.isNotNull() & (F.size(some) == 1)
    at = F.instr(F.trim(text), ref["word"])
    put = F.concat(F.left(F.trim(text), at - 1), F.element_at(some, 1), F.substr(F.trim(text), at + F.length(ref["word"])))
    yes, no = F.coalesce(one, F.lit(False)), F.coalesce(ref.isNotNull() & (F.size(some) != 1), F.lit(False))
    return F.struct(F.when(yes, put).otherwise(F.coalesce(text, F.lit(""))).alias("text"), yes.alias("resolved"), no.alias("ambiguous"), ref["kind"].alias("kind"))


def key_terms(text: Column, entities: Column, terms: tuple[str, ...] = ()) -> Column:
    """Terms for the exact channel: entities of key kinds, the first clause and document in the text, known terms; the text itself if there are none."""
    named = F.transform(F.filter(F.coalesce(entities, F.array().cast("array<struct<kind:string,value:string>>")), lambda e: e["kind"].isin(*KEY_KINDS)), lambda e: e["value"])
    found = F.array(F.regexp_extract(text, CLAUSE, 0), F.regexp_extract(text, DOCUMENT, 0))
    known = F.filter(F.array(*map(F.lit, terms)).cast(TEXTS), lambda t: F.contains(text, t)) if terms else _none()
    every = F.filter(F.array_distinct(F.concat(named, found, known)), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(F.size(every) > 0, F.array_join(every, " ")).otherwise(text)


def channel_queries(text: Column, entities: Column, synonyms: dict[str, tuple[str, ...]]) -> Column:
    """map: lexical the (resolved) text, dense the text with synonyms, exact its key terms; empty for a blank text."""
    wide = expanded(text, synonyms) if synonyms else text
    some = F.create_map(F.lit("lexical"), text, F.lit("dense"), wide, F.lit("exact"), key_terms(text, entities, tuple(synonyms)))
    return F.when(F.coalesce(F.trim(text), F.lit("")) != "", some).otherwise(F.create_map().cast("map<string,string>"))


def complexity(intent: Column, ambiguities: Column) -> Column:
    """The intent's level (L2 if unknown), one higher with an ambiguity, L4 at most; a greeting stays L0."""
    base = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COMPLEXITY.items() for x in kv)), intent), F.lit("L2"))
    up = (F.coalesce(F.size(ambiguities), F.lit(0)) > 0) & (base != "L0")
    at = F.array_position(F.lit(list(LEVELS)), base) + up.cast("int")
    return F.element_at(F.lit(list(LEVELS)), F.least(at, F.lit(len(LEVELS))).cast("int"))


def raised_risk(base: Column, level: Column) -> Column:
    """The base risk, low raised to medium from L3 on, medium to high at L4 (so a low one there becomes high)."""
    medium = F.when(level.isin("L3", "L4") & (base == "low"), "medium").otherwise(base)
    return F.when((level == "L4") & (medium == "medium"), "high").otherwise(medium)
