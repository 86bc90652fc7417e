"""Questions as rows: anchors, synonyms, risk, ambiguities, channel queries. Rule tables are parameters; all are JVM expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (kind, pattern, weight) of anchors, their first group being the value.
ANCHORS = (
    ("doc_name", r"《([^》]+)》", 0.9),
    ("clause_number", r"第([一二三四五六七八九十百零\d]+)条", 0.85),
    ("chapter_number", r"第([一二三四五六七八九十百零\d]+)章", 0.85),
    ("regulation_no", r"第\s*(\d+)\s*号", 0.8),
    ("attachment_no", r"附件\s*([一二三四五六七八九十\d]+)", 0.75),
    ("percentage", r"(\d+(?:\.\d+)?\s*%)", 0.6),
    ("date", r"(\d{4}\s*年(?:\d{1,2}\s*月(?:\d{1,2}\s*日)?)?)", 0.6),
    ("year", r"(\d{4})\s*(?:年|季度)", 0.55),
)
METRIC_WEIGHT, TERM_WEIGHT, STRONG, MOST_ANCHORS = 0.8, 0.5, 0.7, 3
# Base risk of each intent, and words that raise it.
BASE_RISK = {"greeting": "low", "clause_query": "low", "definition": "low", "overview": "low", "table_lookup": "low", "threshold": "medium", "comparison": "medium", "unknown": "medium", "compliance": "high"}
PROHIBITIVE = ("不得", "禁止", "严禁", "不准", "不得低于", "不得超过", "不得少于", "不得高于", "不得违反")
PENALTY = ("处罚", "违规", "违法", "罚款", "罚没", "行政处罚", "法律责任", "追责", "处分", "惩戒")
COMPLIANCE = ("是否符合", "是否满足", "是否合规", "是否达标", "是否违反", "是否可以", "能不能", "可不可以")
THRESHOLD = ("最低", "最高", "不少于", "不超过", "至少", "至多", "不低于", "不高于", "下限", "上限", "要求", "标准")
QUANTITY = r"\d+(?:\.\d+)?%|\d+(?:\.\d+)?(?:万亿|亿|万|千)元"
# Words that refer to something unnamed, and questions for a number without its metric.
VAGUE = ("那个", "那个规定", "那个文件", "那个制度", "之前的规定", "之前那个", "上次说的", "刚才提到的", "它", "它们", "这个", "这些")
UNSCOPED = r"(?:比例|比率|要求)(?:是多少|多少|几)|(?:标准|阈值)(?:是多少|多少|几)|那个.*(?:是多少|多少)"


def _any(text: Column, words: Iterable[str]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def anchors(text: Column, patterns: Iterable[tuple[str, str, float]] = ANCHORS, metrics: Iterable[str] = (), terms: Iterable[str] = ()) -> Column:
    """array of (kind, value, weight): matches by pattern, then metrics, then terms; each value once, heaviest first.

    Of equal weights the earlier found goes first. A null or blank text has none.
    """

    def named(kind: str, values: Column, weight: float) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value"), F.lit(weight).alias("weight")))

    found = [named(kind, F.regexp_extract_all(text, F.lit(rx), F.lit(1)), weight) for kind, rx, weight in patterns]
    for kind, words, weight in (("metric_name", tuple(metrics), METRIC_WEIGHT), ("term", tuple(terms), TERM_WEIGHT)):
        if words:
            found.append(named(kind, F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)), weight))
    every = F.filter(F.concat(*found), lambda a: a["value"] != "")
    first = F.filter(every, lambda a, i: F.array_position(F.transform(every, lambda b: b["value"]), a["value"]) == i + 1)
    placed = F.transform(first, lambda a, i: F.struct((-a["weight"]).alias("w"), i.alias("i"), a.alias("a")))
    return F.coalesce(F.transform(F.array_sort(placed), lambda p: p["a"]), F.array().cast("array<struct<kind:string,value:string,weight:double>>"))


def enhanced(text: Column, found: Column, strong: float = STRONG, most: int = MOST_ANCHORS) -> Column:
    """The text with its heaviest anchors (at most `most`, of weight `strong` or more) before it."""
    heavy = F.slice(F.filter(found, lambda a: a["weight"] >= strong), 1, most)
    return F.array_join(F.concat(F.transform(heavy, lambda a: a["value"]), F.array(text)), " ")


def expanded(text: Column, synonyms: dict[str, tuple[str, ...]]) -> Column:
    """The text followed by the synonyms of its terms, without those it has already.

    A term inside a longer found term is not expanded; longer terms come first, equally long ones in the table's order.
    """
    order = sorted(synonyms, key=lambda t: -len(t))
    known = [t for t in dict.fromkeys((*order, *(s for v in synonyms.values() for s in v)))]
    table = F.array(*(F.struct(F.lit(t).alias("term"), F.array(*(F.lit(s) for s in synonyms[t])).alias("more")) for t in order))
    met = F.filter(table, lambda r: F.contains(text, r["term"]))
    longest = F.filter(met, lambda r: ~F.exists(met, lambda o: (F.length(o["term"]) > F.length(r["term"])) & F.contains(o["term"], r["term"])))
    had = F.filter(F.array(*(F.lit(k) for k in known)), lambda k: F.contains(text, k))
    more = F.array_except(F.array_distinct(F.flatten(F.transform(longest, lambda r: r["more"]))), had)
    return F.array_join(F.concat(F.array(text), more), " ")


def risk(intent: Column, text: Column, words: Iterable[str] = (*PROHIBITIVE, *PENALTY, *COMPLIANCE), thresholds: Iterable[str] = THRESHOLD, quantity: str = QUANTITY) -> Column:
    """low, medium or high: the intent's base risk, high with a word of prohibition, penalty or compliance, or with a
    quantity and a threshold word. Unknown intents are medium; a null text raises nothing."""
    base = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BASE_RISK.items() for x in kv)), intent), F.lit("medium"))
    up = _any(text, words) | (text.rlike(quantity) & _any(text, thresholds))
    return F.when(F.coalesce(up, F.lit(False)), "high").otherwise(base)


def ambiguities(text: Column, intent: Column, has_metric: Column, has_version: Column, vague: Iterable[str] = VAGUE, unscoped: str = UNSCOPED, several: Iterable[str] = (), versions: Iterable[str] = ()) -> Column:
    """array of kinds, each at most once: entity_ambiguous, scope_missing, term_polysemous, version_unclear."""
    checks = (("entity_ambiguous", _any(text, vague)), ("scope_missing", (intent == "threshold") & ~has_metric & text.rlike(unscoped)), ("term_polysemous", ~has_metric & _any(text, several) if several else F.lit(False)), ("version_unclear", ~has_version & _any(text, versions) if versions else F.lit(False)))
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks)))


def answer(intent: Column, texts: Column, templates: dict[str, str], most: int = 5, cut: int = 150) -> Column:
    """A template answer: the intent's heading, then at most `most` numbered evidence texts cut to `cut` characters.

    Without evidence it is the refusal template ('none'); an unknown intent takes the heading 'other'.
    """
    head = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in templates.items() for x in kv)), intent), F.lit(templates["other"]))
    lines = F.transform(F.slice(texts, 1, most), lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.left(t, F.lit(cut))))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) < 1, F.lit(templates["none"])).otherwise(F.array_join(F.concat(F.array(head), lines), "\n"))
