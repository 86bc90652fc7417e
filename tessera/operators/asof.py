"""As-of joins: the version in force at a time, without a range join, and what a version's dates and state say of it.

Starts of versions and questions are one sequence per key; in its order the last start before a question is its version.
A key with very many rows is cut into ranges of time, and each range begins with the last version before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one key that one task sorts; keys with more are cut by time.
RANGE_ROWS = 1_000_000
# Words for a version's state, and the dates that a text may hold.
ACTIVE, SUPERSEDED, REPEALED = ("active", "current", "in_force", "有效"), ("superseded", "replaced", "已被替代"), ("repealed", "abolished", "废止", "已废止")
DATE = r"(\d{4})[-年./](\d{1,2})[-月./](\d{1,2})日?"


def _cuts(rows: DataFrame, most: int) -> DataFrame | None:
    """(key, cuts): for each key with more than `most` rows the times at which it is cut; in all at most twice the rows over `most` times."""
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    top = sizes.agg(F.max("n")).first()[0]
    if top is None:
        return None
    steps = min(-(-top // most), 10_000)
    at = F.percentile_approx("_t", [i / steps for i in range(1, steps)] or [0.5], 100_000)
    found = rows.join(F.broadcast(sizes), "_key").groupBy("_key", "n").agg(at.alias("at"))
    parts = F.greatest(F.least(F.ceil(F.col("n") / most), F.size("at") + 1), F.lit(2)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("at", F.least(F.floor(i * (F.size("at") + 1) / parts), F.size("at")).cast("int") - 1))
    return found.select("_key", F.array_distinct(picked).alias("cuts"))


def as_of(asks: DataFrame, versions: DataFrame, by: list[str], asked: str, effective: str, superseded: str | None = None, tie: str | None = None, most: int = RANGE_ROWS) -> DataFrame:
    """asks with `version`, the last of their key's versions with effective <= asked, and `state`.

    state: not_yet_effective without such a version, superseded if asked is at its superseded time or later, else active.
    version is a struct of all columns of versions. Of versions with the same start the largest `tie` counts (without it
    the largest by superseded, then any).

    * a null key or asked time: no version; versions without a key or start are never in force; repeated asks: each;
    * a null superseded time: in force for good. A key of any size is spread over tasks, except for rows of one time.
    """
    own = F.struct(*(F.col(c) for c in versions.columns))
    order = F.struct(*(F.col(c) for c in (tie, superseded) if c), F.lit(0).alias("_")) if (tie or superseded) else F.struct(F.lit(0).alias("_"))
    starts = versions.select(F.struct(*by).alias("_key"), F.col(effective).alias("_t"), own.alias("version"), order.alias("_o"))
    whole = " AND ".join(f"_key.`{c}` IS NOT NULL" for c in by) + " AND _t IS NOT NULL"
    starts = starts.filter(whole)
    wanted = asks.select(F.struct(*by).alias("_key"), F.col(asked).alias("_t"), F.struct(*asks.columns).alias("_ask"))
    placed = starts.select("_key", "_t", F.lit(0).alias("_side"), "_o", "version").unionByName(
        wanted.filter(whole).select("_key", "_t", F.lit(1).alias("_side"), "_ask"), allowMissingColumns=True
    )
    cuts = _cuts(placed.select("_key", "_t"), most)
    if cuts is None:
        ranged = placed.withColumn("_part", F.lit(0))
    else:
        # A row goes to the range of the number of cuts before its time, so equal times stay together.
        ranged = placed.join(F.broadcast(cuts), "_key", "left").withColumn("_part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("_t"))), F.lit(0)))
        ranged = ranged.withColumn("_part", F.when(F.col("cuts").isNull(), 0).otherwise(F.col("_part")))
        last = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_o", "version")))
        ends = ranged.filter("cuts IS NOT NULL").groupBy("_key", "_part").agg(last.alias("last"))
        before = F.last("last", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.withColumn("last", before).filter("last IS NOT NULL").select("_key", "_part", F.lit(-1).alias("_side"), F.col("last.version").alias("version"), F.col("last._o").alias("_o"))
        ranged = ranged.drop("cuts").unionByName(carried, allowMissingColumns=True)
    latest = F.last("version", ignorenulls=True).over(Window.partitionBy("_key", "_part").orderBy(F.asc_nulls_first("_t"), "_side", "_o").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("version", latest).filter("_side = 1").select("_ask.*", "version")
    never = asks.filter(F.coalesce(~_all_set([*by, asked]), F.lit(True))).withColumn("version", F.lit(None).cast(found.schema["version"].dataType))
    out = found.unionByName(never)
    over = F.coalesce(F.col(asked) >= F.col("version")[superseded], F.lit(False)) if superseded else F.lit(False)
    return out.withColumn("state", F.when(F.col("version").isNull(), "not_yet_effective").when(over, "superseded").otherwise("active"))


def _all_set(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out


def iso_date(text: Column) -> Column:
    """The first date of a text as YYYY-MM-DD; a text without one as it is, a null one as the empty string."""
    part = lambda i: F.regexp_extract(text, DATE, i)
    whole = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) != "", whole).otherwise(F.coalesce(text, F.lit("")))


def version_issue(status: Column, effective: Column, superseded: Column, content: Column, asked: Column) -> Column:
    """struct(issue, verdict) of a version told in words, at an asked date ('' or null: its state alone).

    The last of these that holds is the issue: a repealed state (error), a superseded or unknown one (warning), a start
    after the asked date (error), a superseded date at or before it (error). verdict is the worst of all. A version without
    a start takes the first date in its content.
    """
    state, at = F.lower(F.coalesce(F.when(status != "", status), F.lit("active"))), iso_date(asked)
    begin = iso_date(F.when(F.coalesce(effective, F.lit("")) != "", effective).otherwise(F.regexp_extract(content, DATE, 0)))
    end = iso_date(superseded)
    told = F.coalesce(at, F.lit("")) != ""
    kinds = [
        (told & (end != "") & (end <= at), "superseded_before_query", 2), (told & (begin != "") & (begin > at), "not_yet_effective", 2), (state.isin(*REPEALED), "repealed", 2),
        (state.isin(*SUPERSEDED), "superseded", 1), (~state.isin(*ACTIVE, *REPEALED, *SUPERSEDED), "unknown_status", 1),
    ]
    issue, worst = F.lit(None).cast("string"), F.greatest(*(F.when(c, n).otherwise(0) for c, _, n in kinds))
    for c, name, _ in reversed(kinds):
        issue = F.when(c, name).otherwise(issue)
    return F.struct(issue.alias("issue"), F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), worst + 1).alias("verdict"))
