"""Column functions shared by the operators. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words of a text: lower case, everything but letters, digits and white space deleted, split at white space."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    return F.filter(F.split(bare, " "), lambda t: t != "")


def each(rows: DataFrame, array: Column, name: str, *kept: str) -> DataFrame:
    """(kept, name): an array's elements, of which none is null, as rows.

    A plain explode makes Spark filter by the array's size below, for which it computes the array again, twice as a rule; the
    outer form leaves that out, and its rows of empty arrays are dropped after.
    """
    return rows.select(*kept, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal, regardless of case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(part.lower()), F.lit("")))) / len(part)).cast("int")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def present(value: Column, *others: Column) -> Column:
    """The first of the values that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in (value, *others)), F.lit(""))


def number(text: Column) -> Column:
    """The text as a double, null where it is none."""
    return text.try_cast("double")


def fingerprint(**fields: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the fields as a JSON object with sorted keys; a null is null, so no two rows of fields look alike."""
    value = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    parts = [F.concat(F.lit(f'"{k}": '), F.when(value(c) != "", value(c)).otherwise("null")) for k, c in sorted(fields.items())]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16)


# The layouts of dates, in the order in which they are tried. Months and days may have one digit where signs part them.
DATE_LAYOUTS = ("yyyy-M-d", "yyyy/M/d", "yyyy'年'M'月'd'日'", "yyyyMMdd", "d/M/yyyy")


def parse_date(text: Column) -> Column:
    """Date of a text in one of five layouts, else null (also for days that do not exist)."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_LAYOUTS))


def compare_dates(a: Column, b: Column) -> Column:
    """struct(comparison, days): before, after or equal, and the days between two texts that are dates; null if one is none."""
    x, y = parse_date(a), parse_date(b)
    how = F.when(x < y, "before").when(x > y, "after").otherwise("equal")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(how.alias("comparison"), F.abs(F.datediff(x, y)).alias("days")))
