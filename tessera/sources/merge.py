"""Tables changed by rows that come later: merges with a rule a column, numbers for new rows, deletions that cascade."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.rounds import settle


def _merged(rule: str, old: Column, new: Column) -> Column:
    rules = {
        "new": new, "old": old, "filled": F.coalesce(F.when(new.cast("string") != "", new), old),
        "max": F.greatest(old, new), "min": F.least(old, new), "sum": F.coalesce(old + new, old, new),
    }
    if rule not in rules:
        raise ValueError(f"unknown rule {rule!r}")
    return rules[rule]


def merge(old: DataFrame, new: DataFrame, key: str, order: str | None = None, rules: Mapping[str, str] | None = None, number: str | None = None) -> DataFrame:
    """old with the rows of new: keys that both have are merged by a rule a column, other rows are added.

    Rules: new (the default), old (kept, as ids and creation times are), filled (the new value unless it is null or empty),
    max, min, sum. Of several new rows of a key the last by `order` counts (without it any). A column that new lacks is kept,
    and null in added rows. `number` names a column whose value in added rows goes on from the largest one, by key.

    Keys are equal if both are null, too. One shuffle by key; a key has one old row and, after the first step, one new one.
    """
    rules = {number: "old", **(rules or {})} if number else dict(rules or {})
    rank = F.struct(F.col(order), F.struct(*(c for c in new.columns if new.schema[c].dataType.typeName() not in ("map", "variant")))) if order else F.struct(F.lit(0))
    latest = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), rank).alias("_new")).withColumnRenamed(key, "_new_key")
    both = old.select(F.col(key).alias("_old_key"), F.struct(*old.columns).alias("_old")).join(latest, F.col("_old_key").eqNullSafe(F.col("_new_key")), "full")
    met = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def value(c: str) -> Column:
        kept = F.col("_old")[c]
        if c not in new.columns:
            return kept
        fresh = F.col("_new")[c].cast(old.schema[c].dataType)
        return F.when(met, _merged(rules.get(c, "new"), kept, fresh)).when(F.col("_old").isNull(), fresh).otherwise(kept)

    out = both.select(*(value(c).alias(c) for c in old.columns), F.col("_old").isNull().alias("_added"))
    if not number:
        return out.drop("_added")
    out = settle(out)
    most = out.agg(F.coalesce(F.max(F.when(~F.col("_added"), F.col(number))), F.lit(0)).cast("long").alias("m")).first()["m"]
    added = numbered(out.filter("_added").drop(number), key, number, most + 1)
    return out.filter("NOT _added").unionByName(added.withColumn(number, F.col(number).cast(old.schema[number].dataType))).select(*old.columns)


def numbered(rows: DataFrame, by: str, name: str, first: int = 0) -> DataFrame:
    """rows with consecutive numbers from `first`, in the order of `by` (of equal ones in any): sorted ranges are counted, and each begins where those before it end."""
    at = settle(rows.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return at.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_before") + place + first).drop("_at", "_part", "_before")


def without(tables: Mapping[str, DataFrame], gone: DataFrame, key: str, at: str | None = None, updated: str | None = None) -> dict[str, DataFrame]:
    """Each of the tables without the rows of the deleted keys, wherever these occur.

    gone(key[, at]); with `at` and `updated` only rows not changed since the deletion go, so that what came again stays.
    Null keys are never deleted; repeated tombstones count once, by the latest.
    """
    last = gone.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(at).alias("_at") if at else F.lit(None).alias("_at"))
    out = {}
    for name, rows in tables.items():
        same = rows[key] == last["_key"]
        out[name] = rows.join(last, same & (rows[updated] <= last["_at"]) if at and updated and updated in rows.columns else same, "left_anti")
    return out
