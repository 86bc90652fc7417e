"""Row-wise classifiers from rule tables: intents, entities, constraints, routes, risk, citations, numbers.

Rules are literals, so they become one expression over the row: no join with a rule table, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import shipped

LEVELS = ("L0", "L1", "L2", "L3", "L4")
# Fixed values: (level, risk) to path; the higher of the two decides.
PATHS = ("P0", "P1", "P2", "P3", "P4")
RISKS = ("low", "medium", "high", "critical")


def intent(text: Column, rules: list[tuple[str, str, float]], several: float = 0.85, unknown: float = 0.3) -> Column:
    """struct(intent, confidence) of rules (intent, regex, confidence).

    The best confidence wins, the first rule on ties; if rules of several intents match it is multiplied by `several`.
    """
    hits = F.filter(F.array(*(F.when(text.rlike(f"(?U){rx}"), F.struct(F.lit(c).alias("confidence"), F.lit(-i).alias("first"), F.lit(name).alias("intent"))) for i, (name, rx, c) in enumerate(rules))), lambda h: h.isNotNull())
    best = F.array_max(hits)
    kinds = F.size(F.array_distinct(F.transform(hits, lambda h: h["intent"])))
    confidence = F.round(F.when(kinds > 1, best["confidence"] * several).otherwise(best["confidence"]), 6)
    return F.struct(F.coalesce(best["intent"], F.lit("unknown")).alias("intent"), F.coalesce(confidence, F.lit(unknown)).alias("confidence"))


def entities(text: Column, patterns: dict[str, str]) -> Column:
    """Distinct (kind, value) of all matches, by pattern order, then by place."""

    def named(kind: str, rx: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?U){rx}"), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.array_distinct(F.concat(*(named(kind, rx) for kind, rx in patterns.items())))


def first_of(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """The first key one of whose words the text contains, else null."""
    low = F.lower(text)
    out = None
    for key, some in words.items():
        hit = F.lit(False)
        for w in some:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return out


def bumped(level: Column, by: Column) -> Column:
    """A complexity level raised by a number of steps, at most to the last."""
    at = F.array_position(F.lit(list(LEVELS)), level) + by
    return F.element_at(F.lit(list(LEVELS)), F.least(at, F.lit(len(LEVELS))).cast("int"))


def path(level: Column, risk: Column) -> Column:
    """The execution path: the higher of the level and the risk's floor (high: P3, critical: P4)."""
    own = F.array_position(F.lit(list(LEVELS)), level)
    floor = F.when(risk == "critical", 5).when(risk == "high", 4).otherwise(1)
    return F.element_at(F.lit(list(PATHS)), F.greatest(own, floor).cast("int"))


def percents(text: Column) -> Column:
    """All percentages of a text as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda v: v.cast("double"))


def cited(text: Column) -> Column:
    """array of (low, high, text): the numbers and ranges of citations like [1], [1,2] and [1-3]; a number too long to be one is null."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*[,-]\s*\d+)*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"\s", ""), ",")))
    ends = lambda p, at: F.element_at(F.split(p, "-"), at).try_cast("long")
    spans = F.transform(parts, lambda p: F.struct(ends(p, 1).alias("low"), ends(p, -1).alias("high"), p.alias("text")))
    return F.coalesce(F.filter(spans, lambda s: F.size(F.split(s["text"], "-")) <= 2), F.array().cast("array<struct<low:bigint,high:bigint,text:string>>"))


def cited_within(text: Column, n: Column) -> Column:
    """Distinct cited numbers from 1 to n, in order. Ranges are cut at n before they are written out."""
    inside = F.filter(cited(text), lambda s: s["low"].isNotNull() & s["high"].isNotNull() & (s["low"] <= n) & (s["high"] >= s["low"]) & (s["high"] >= 1))
    spans = F.transform(inside, lambda s: F.sequence(F.greatest(s["low"], F.lit(1).cast("long")), F.least(s["high"], n.cast("long"))))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def cited_beyond(text: Column, n: Column) -> Column:
    """Distinct cited numbers and ranges, as written, that reach below 1 or beyond n."""
    return F.array_distinct(F.transform(F.filter(cited(text), lambda s: s["low"].isNull() | s["high"].isNull() | (s["low"] < 1) | (s["high"] > n)), lambda s: s["text"]))


def cited_names(text: Column) -> Column:
    """Sources named as (来源: x) or (引用: x)."""
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(r"\((?:来源|引用)[：:]\s*([^)]+)\)"), F.lit(1)), F.array().cast("array<string>")), lambda s: F.trim(s))


def intent_of(text: Column, rules: tuple[tuple[str, str, float], ...] = shipped.INTENTS) -> Column:
    """struct(intent, confidence, rules) of the trimmed text: the shipped intents, or others of the same form, without regard to case.

    The highest confidence wins, the earlier rule among equals; hits of several intents lower it to 0.85 of it. rules are the
    winner's patterns that hit, highest confidence first. No hit: unknown with 0.3; a null or blank text: unknown with 0.
    """
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    met = [F.when(whole.rlike(f"(?Ui){rx}"), F.struct(F.lit(-c).alias("down"), F.lit(i).alias("nth"), F.lit(name).alias("intent"), F.lit(rx).alias("rule"))) for i, (name, rx, c) in enumerate(rules)]
    hits = F.array_sort(F.array_compact(F.array(*met)))
    best = F.get(hits, F.lit(0))
    several = F.size(F.array_distinct(F.transform(hits, lambda h: h["intent"]))) > 1
    sure = F.round(-best["down"] * F.when(several, 0.85).otherwise(1.0), 4)
    own = F.transform(F.filter(hits, lambda h: h["intent"] == best["intent"]), lambda h: h["rule"])
    none = F.array().cast("array<string>")
    confidence = F.when(F.coalesce(whole, F.lit("")) == "", 0.0).otherwise(F.coalesce(sure, F.lit(0.3)))
    return F.struct(F.coalesce(best["intent"], F.lit("unknown")).alias("intent"), confidence.alias("confidence"), F.coalesce(own, none).alias("rules"))


def constraints_of(text: Column) -> Column:
    """struct(time_range, version_status, applicable_scope, normative_level) by the shipped words: the first of each that occurs, of states each once."""
    first = lambda words: F.get(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(v)) for w, v in words))), F.lit(0))
    times = F.get(F.filter(F.array(*(F.regexp_extract(text, f"(?U){rx}", 1) for rx in shipped.TIMES)), lambda t: t != ""), F.lit(0))
    states = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(v)) for w, v in shipped.STATES))))
    return F.struct(times.alias("time_range"), states.alias("version_status"), first(shipped.SCOPES).alias("applicable_scope"), first(shipped.NORMS).alias("normative_level"))


def patterned(text: Column) -> Column:
    """array of (kind, value, confidence): what the shipped patterns and terms find, repeats included."""
    form = "array<struct<kind:string,value:string,confidence:double>>"
    made = lambda kind, values, sure: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(sure).alias("confidence")))
    found = [made(kind, F.regexp_extract_all(text, F.lit(f"(?U){rx}"), F.lit(group)), sure) for kind, rx, group, sure in shipped.PATTERNS]
    for rx, sure in shipped.TERMS:
        # what begins with any run of a line is found from the line's begin or the last match on, or nowhere further on in that line
        begin = r"(?m)(?:\G|^)" if rx.startswith("(.+?)") else ""
        terms = F.transform(F.regexp_extract_all(text, F.lit(f"(?U){begin}{rx}"), F.lit(1)), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))
        found.append(made("term", F.filter(terms, lambda v: (v != "") & (F.length(v) <= shipped.LONGEST_TERM)), sure))
    return F.coalesce(F.concat(*found), F.array().cast(form))
