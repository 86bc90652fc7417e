"""Metadata filters, exact matching and progressive relaxation."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import count_of, number

#: Fields that eq compares by substring, regardless of case.
SUBSTRING_FIELDS = ("doc_name", "doc_title")
#: A list of words, compared as one text.
WORD_LISTS = ("keywords",)


def valid_pattern(pattern: str) -> bool:
    """Whether the JVM compiles a regular expression; checked once on the driver, so that a bad one cannot end a query."""
    jvm = SparkSession.active().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def predicate(field: str, op: str, value: object, substring_fields: tuple[str, ...] = SUBSTRING_FIELDS) -> Column:
    """One condition. Operators: eq, in, contains, regex, prefix, suffix, gt, gte, lt, lte; a null field never matches, nor does a pattern that is none.

    eq on one of substring_fields is a substring regardless of case. On `keywords` (an array or a text) eq and contains ask
    for a substring of its words joined by spaces, in the same case; contains takes a list for any of several.
    """
    c = F.col(field)
    text = F.lower(c.cast("string"))
    if op in ("eq", "contains") and field in WORD_LISTS:
        wanted = value if op == "contains" and isinstance(value, (list, tuple)) else (value,)
        joined = F.when(c.isNotNull(), F.concat_ws(" ", c))
        out = reduce(lambda a, b: a | b, (F.contains(joined, F.lit(str(v))) for v in wanted), F.lit(False))
    elif op == "eq":
        out = text.contains(str(value).lower()) if field in substring_fields else c.cast("string") == str(value)
    elif op == "in":
        out = reduce(lambda a, b: a | b, (predicate(field, "eq", v, substring_fields) for v in value), F.lit(False))
    elif op == "contains":
        out = text.contains(str(value).lower())
    elif op == "regex":
        out = c.cast("string").rlike(f"(?U){value}") if valid_pattern(f"(?U){value}") else F.lit(False)
    elif op in ("prefix", "suffix"):
        out = (text.startswith if op == "prefix" else text.endswith)(str(value).lower())
    elif op in ("gt", "gte", "lt", "lte"):
        n, v = number(c.cast("string")), float(value)
        out = {"gt": n > v, "gte": n >= v, "lt": n < v, "lte": n <= v}[op]
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(out, F.lit(False))


def metadata_filter(rows: DataFrame, conditions: dict[str, tuple[str, object]], order: str, limit: int | None = None, substring_fields: tuple[str, ...] = SUBSTRING_FIELDS) -> DataFrame:
    """AND of the conditions; unknown fields and empty values are ignored. With a limit: the first rows by order."""
    used = [predicate(f, op, v, substring_fields) for f, (op, v) in conditions.items() if f in rows.columns and v not in (None, "")]
    out = rows.filter(reduce(lambda a, b: a & b, used)) if used else rows
    return out if limit is None else out.orderBy(order).limit(limit)


def relax(rows: DataFrame, levels: list[dict[str, tuple[str, object]]]) -> DataFrame:
    """Rows of the first level of filters that has any, with its number, in one pass over the rows.

    A row carries its own first level; the least of these over all rows decides (one row, so it may go to all tasks).
    """
    conditions = [reduce(lambda a, b: a & b, (predicate(f, op, v) for f, (op, v) in level.items()), F.lit(True)) for level in levels]
    level = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(conditions)))
    tagged = rows.withColumn("level", level).filter("level IS NOT NULL")
    least = tagged.agg(F.min("level").alias("least"))
    return tagged.join(F.broadcast(least), F.col("level") == F.col("least")).drop("least")


def exact_match(rows: DataFrame, query: str, mode: str, text: str = "content", key: str = "chunk_id") -> DataFrame:
    """(key, score, match_pos) of the rows that match; modes exact, contains, regex and prefix (of a line).

    A pattern that is none gives one row: the least key, score 0, place -1.
    """
    c, q = F.col(text), query.strip()
    if mode == "exact":
        hit, score, pos = F.lower(F.trim(c)) == q.lower(), F.lit(1.0), F.lit(0)
    elif mode == "contains":
        n = count_of(c, query)
        hit, score, pos = n > 0, F.least(n, F.lit(10)) / 10.0, F.instr(F.lower(c), query.lower()) - 1
    elif mode == "regex":
        if not valid_pattern(f"(?i){query}"):
            return rows.agg(F.min(key).alias(key), F.lit(0.0).alias("score"), F.lit(-1).alias("match_pos"))
        n = F.regexp_count(c, F.lit(f"(?i){query}"))
        hit, score, pos = n > 0, F.least(n, F.lit(10)) / 10.0, F.regexp_instr(c, F.lit(f"(?i){query}")) - 1
    elif mode == "prefix":
        hit, score, pos = F.exists(F.split(c, "\n"), lambda x: F.lower(F.trim(x)).startswith(q.lower())), F.lit(1.0), F.lit(0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.filter(hit).select(key, score.cast("double").alias("score"), pos.cast("int").alias("match_pos"))


def field_counts(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
