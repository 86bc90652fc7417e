"""Facts in evidence: numbers with their metric and unit, scopes and what they contain, all kinds of conflict in one table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import overlapping_scopes

# Words between a metric and its number, and what ends a phrase.
COMPARATORS = (
    "不得低于", "不低于", "不得高于", "不高于", "不得超过", "不超过", "应不低于", "应不高于", "应当不低于", "应当不高于", "至少", "最高",
    "最低", "应达到", "达到", "为", "等于", "不大于", "不小于", "大于", "小于",
)
PHRASE_ENDS = re.compile(r"[，。、；;：:！？\n\r\t（）()【】\[\] …]+")
PERCENT = re.compile(r"(\d+(?:\.\d+)?)\s*[%％]")
NUMBER = re.compile(r"(?<![.\w])(\d+(?:\.\d+)?)(?![.\w])")
# Standard units and their other names.
UNITS = {"%": ("%", "百分号", "百分比"), "bps": ("bps", "基点", "BP", "BPs"), "万元": ("万元", "万人民币"), "亿元": ("亿元", "亿人民币"), "元": ("元", "人民币", "RMB", "CNY")}
# Words of each scope, and what a scope contains.
SCOPES = {
    "all_banks": ("所有银行", "全部银行", "各类银行", "商业银行"),
    "systemically_important": ("系统重要性银行", "系统重要性机构", "D-SIB"),
    "non_systemically_important": ("非系统重要性银行", "非系统重要性机构"),
    "state_owned": ("国有大型银行", "国有银行"),
    "joint_stock": ("股份制银行", "股份制商业银行"),
    "city_commercial": ("城商行", "城市商业银行"),
    "rural": ("农商行", "农村商业银行", "农村信用社"),
    "foreign": ("外资银行", "外国银行"),
}
WIDEST = "all_banks"
# The order in which conflicts are shown, and advice on each.
PRIORITY = {"authority": 1, "version": 2, "temporal": 3, "scope": 4, "numeric": 5}
OTHER_PRIORITY = 9
ADVICE = {
    "authority": "建议以效力更高的文件为准",
    "version": "建议以最新版本为准",
    "temporal": "注意过渡期条款适用",
    "scope": "建议核实适用范围，按特别规定优先原则处理",
    "numeric": "建议核实数据来源，以权威文件最新数值为准",
}
FACT = "array<struct<metric:string,text:string,value:double>>"


def metric_before(text: str, start: int) -> str:
    """The metric that a number at `start` is about: the last phrase before the comparator nearest to it, or of the 12 characters before it."""
    lead = text[:start]
    ends = [at for at in map(lead.rfind, COMPARATORS) if at >= 0]
    lead = lead[: max(ends)] if ends else lead[-12:]
    phrases = [p for p in PHRASE_ENDS.split(lead) if p]
    name = phrases[-1].strip() if phrases else ""
    name = name[-12:] if len(name) > 15 else name
    return "" if len(name) < 2 or name.isdigit() else name.lower()


def facts_in(text: str, metric: str = "") -> list[tuple[str, str, float]]:
    """(metric, text, value) of percentages, then of other numbers, without years; a given metric goes before what the text says."""
    text, metric = text or "", (metric or "").strip().lower()
    percents = list(PERCENT.finditer(text))
    taken = [m.span() for m in percents]
    plain = [m for m in NUMBER.finditer(text) if not any(a <= m.start() < b for a, b in taken) and not text[m.end() :].lstrip().startswith("年")]
    found = [(metric or metric_before(text, m.start()), m[0].strip() if m.re is PERCENT else m[1], float(m[1])) for m in (*percents, *plain)]
    return [f for f in found if f[0]]


def numeric_facts(text: Column, metric: Column | None = None) -> Column:
    """facts_in of a column: Python over Arrow batches, as the place of each match decides its metric."""

    @F.pandas_udf(FACT)
    def of(texts: pd.Series, metrics: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("metric", "text", "value"), f, strict=True)) for f in facts_in(t, m)] for t, m in zip(texts, metrics, strict=True)])

    return of(text, F.lit("") if metric is None else metric)


def standard_unit(unit: Column, units: dict[str, tuple[str, ...]] = UNITS) -> Column:
    """The standard name of a unit; an unknown one in lower case; '' for none."""
    names = {a.lower(): k for k, some in units.items() for a in some}
    low = F.lower(F.coalesce(unit, F.lit("")))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), low), low)


def unmet_numbers(claims: DataFrame, evidence: DataFrame, by: str, tolerance: float = 0.01) -> DataFrame:
    """(by, claim_id, value, unit, problem) of claims(by, claim_id, value, unit) that no number of the group's evidence(by, value, unit) meets.

    A number meets another within the tolerance if their units are the same or one of them has none. problem is 'unit'
    where only the unit differs, else 'value'. Numbers meet in bins twice the tolerance wide, so that the range condition is an
    equality join with a check.
    """
    bin_of = lambda c: F.floor(c / (2 * tolerance))
    known = evidence.select(by, F.col("value").alias("_known"), standard_unit(F.col("unit")).alias("_of"), bin_of(F.col("value")).alias("_bin")).distinct()
    near = claims.select(by, "claim_id", "value", "unit", F.explode(F.array(*(bin_of(F.col("value")) + d for d in (-1, 0, 1)))).alias("_bin"))
    met = near.join(known, [by, "_bin"]).filter(F.abs(F.col("value") - F.col("_known")) <= tolerance)
    own = standard_unit(F.col("unit"))
    fits = (own == "") | (F.col("_of") == "") | (own == F.col("_of"))
    best = met.groupBy(by, "claim_id", "value").agg(F.max(fits.cast("int")).alias("_fits"))
    out = claims.join(best, [by, "claim_id", "value"], "left").filter(F.coalesce("_fits", F.lit(0)) == 0)
    return out.select(by, "claim_id", "value", "unit", F.when(F.col("_fits") == 0, "unit").otherwise("value").alias("problem"))


def scopes_in(text: Column, words: dict[str, tuple[str, ...]] = SCOPES) -> Column:
    """Scopes one of whose words the text contains, in the table's order."""
    hit = lambda some: F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(F.coalesce(text, F.lit("")), w))
    return F.array_compact(F.array(*(F.when(hit(some), F.lit(k)) for k, some in words.items())))


def check_scopes(claims: DataFrame, evidence: DataFrame, by: str, words: dict[str, tuple[str, ...]] = SCOPES, widest: str = WIDEST) -> DataFrame:
    """(by, uncovered, verdict) of claims(by, text): scopes that the evidence(by, text) does not cover; the widest one covers all.

    ok without a scope in the claim, or all covered; unknown where the evidence names none; else mismatch.
    """
    named = evidence.groupBy(by).agg(F.array_distinct(F.flatten(F.collect_set(scopes_in(F.col("text"), words)))).alias("_known"))
    both = claims.select(by, scopes_in(F.col("text"), words).alias("_own")).join(named, by, "left")
    known = F.coalesce("_known", F.array().cast("array<string>"))
    left = F.when(F.array_contains(known, widest), F.array().cast("array<string>")).otherwise(F.array_except("_own", known))
    out = both.withColumn("uncovered", left)
    verdict = F.when(F.size("_own") == 0, "ok").when(F.size(known) == 0, "unknown").when(F.size("uncovered") > 0, "mismatch").otherwise("ok")
    return out.select(by, F.when(F.size(known) > 0, F.col("uncovered")).otherwise(F.array().cast("array<string>")).alias("uncovered"), verdict.alias("verdict"))


def all_conflicts(evidence: DataFrame) -> DataFrame:
    """(priority, kind, subject, n, advice) of evidence(doc, metric, value, level, status, effective, scope, content): all five kinds, in the order to show.

    authority: a metric with several values under several levels; version: a document both active and superseded, with several contents;
    temporal: a document with several days of coming into force; scope: an overlap of the scopes of two documents; numeric: a
    metric with several values. n is how many values, contents, days or documents disagree. Each is found by counting groups,
    never by pairing rows.
    """
    m = evidence.filter(F.col("metric").isNotNull()).groupBy(F.col("metric").alias("subject")).agg(*(F.count_distinct(c).alias(c) for c in ("value", "level")))
    kinds = {"authority": ((F.col("value") >= 2) & (F.col("level") >= 2), "level"), "numeric": (F.col("value") >= 2, "value")}
    cells = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("kind"), F.col(n).alias("n"))) for k, (c, n) in kinds.items())))
    by_metric = m.select("subject", F.explode(cells).alias("c")).select("c.kind", "subject", "c.n")
    states = evidence.groupBy(F.col("doc").cast("string").alias("subject")).agg(F.max((F.col("status") == "active").cast("int")).alias("a"), F.max((F.col("status") == "superseded").cast("int")).alias("s"), F.count_distinct("content").alias("n"), F.count_distinct("effective").alias("days"))
    temporal = states.filter("days >= 2").select(F.lit("temporal").alias("kind"), "subject", F.col("days").alias("n"))
    version = states.filter("a = 1 AND s = 1 AND n > 1").select(F.lit("version").alias("kind"), "subject", "n")
    over = overlapping_scopes(evidence, "doc", "scope")
    own = F.col("scope") == F.col("inside")
    scope = over.select(F.lit("scope").alias("kind"), F.when(own, F.col("scope")).otherwise(F.concat_ws(" > ", "scope", "inside")).alias("subject"), F.when(own, F.col("n_docs")).otherwise(F.col("n_docs") + F.col("n_inside")).alias("n"))
    return ordered(by_metric.unionByName(version).unionByName(temporal).unionByName(scope))


def ordered(conflicts: DataFrame, priority: dict[str, int] = PRIORITY, advice: dict[str, str] = ADVICE) -> DataFrame:
    """conflicts(kind, subject, ...) with priority and advice, most urgent first; ties by subject."""
    table = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("kind"))
    return conflicts.withColumn("priority", F.coalesce(table(priority), F.lit(OTHER_PRIORITY))).withColumn("advice", F.coalesce(table(advice), F.lit(""))).orderBy("priority", "subject")
