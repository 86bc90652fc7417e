"""Deduplication, evidence, sufficiency and conflicts over hit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import containment
from tessera.sources.rounds import settle

# Weights of norm levels, version states, and the parts of the sufficiency score.
AUTHORITY = {"law": 1.0, "regulation": 0.9, "department_rule": 0.75, "normative_document": 0.6, "other": 0.4}
VERSION = {"active": 1.0, "superseded": 0.3, "other": 0.5}
PARTS = {"coverage": 0.30, "authority": 0.15, "version": 0.20, "condition": 0.15, "channel": 0.20}
PENALTY = {"authority": 0.15, "version": 0.10, "numeric": 0.12, "other": 0.08}
MISSING_PENALTY, MISSING_CAP, SUFFICIENT = 0.05, 0.3, 0.85


def first_by(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row a key, the first by order. The window's rank limit is applied in each task before the shuffle."""
    return rows.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_n = 1").drop("_k", "_n")


def dedup_ids(hits: DataFrame) -> DataFrame:
    """First row of each chunk_id by idx; rows with an empty or null id are all kept."""
    named = F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != ""
    return first_by(hits.filter(named), F.col("chunk_id"), [F.col("idx")]).unionByName(hits.filter(~named))


def dedup_contents(hits: DataFrame, key: str | None = None) -> DataFrame:
    """Best score of each trimmed content, the first by idx on ties. key: the column that holds content_key, where hits come without contents."""
    return first_by(hits, F.col(key) if key else content_key(), [F.desc("score"), F.col("idx")])


def content_key() -> Column:
    return F.unhex(F.md5(F.trim("content")))


def dedup_contained(hits: DataFrame) -> DataFrame:
    """Drop contents that a longer content contains (both of at least ten characters). Contents are joined once, whatever their copies; the hits are written, as they are read several times."""
    hits = settle(hits.withColumn("_row", F.monotonically_increasing_id()))
    rows = hits.select(F.col("_row").alias("id"), F.col("content").alias("t"))
    first = settle(containment.firsts(rows.filter(F.length("t") >= containment.SHORTEST)))
    gone = first.join(containment.contained_rows(rows, first.select("id")).select("id"), "id", "left_semi").select(F.col("digest").alias("_gone"))
    return hits.join(gone, containment.digest("content") == F.col("_gone"), "left_anti").drop("_row")


def dedup_stages(hits: DataFrame) -> DataFrame:
    """idx of the hits that dedup_ids, dedup_contents and dedup_contained leave one after the other.

    Contents stay where they are: the first two stages shuffle digests, the last one keys and sizes. So hits are read several
    times and must come out the same each time, as rows of a table do, each with an idx (long) of its own.
    """
    narrow = hits.select("idx", "chunk_id", "score", content_key().alias("key"))
    kept = settle(dedup_contents(dedup_ids(narrow), "key").select("idx"))
    gone = containment.contained_rows(hits.select(F.col("idx").alias("id"), F.col("content").alias("t")), kept.select(F.col("idx").alias("id")))
    return kept.join(gone.select(F.col("id").alias("idx")), "idx", "left_anti")


def parents(hits: DataFrame, separator: str = " > ") -> DataFrame:
    """Best hit of each parent (group_key, chunk_id, score, children, child_scores, place) of hits(chunk_id, score, idx, parent_id[, path]).

    Hits are grouped by parent_id, else by the path before its last separator, else each stays single (group_key null). The
    best is the first by idx on ties. children are distinct ids in order of idx, with their first scores to 6 digits. place
    numbers the result by falling score; of equal scores single hits come first, then groups by their first hit.
    """
    up = F.lit(None).cast("string")
    if "path" in hits.columns:
        lead = F.substring_index("path", separator, F.size(F.split("path", f"\\Q{separator}\\E")) - 1)
        up = F.when(F.contains("path", F.lit(separator)) & (F.trim(lead) != ""), F.concat(F.lit("path:"), lead))
    parent = F.nullif(F.col("parent_id").cast("string"), F.lit(""))
    keyed = hits.withColumn("group_key", F.coalesce(F.concat(F.lit("pid:"), parent), up))
    once = keyed.filter("group_key IS NOT NULL").groupBy("group_key", "chunk_id").agg(F.min("idx").alias("idx"), F.min_by("score", "idx").alias("first"), F.max(F.struct("score", -F.col("idx"))).alias("best"))
    best = once.groupBy("group_key").agg(F.max_by("chunk_id", "best").alias("chunk_id"), F.max("best")["score"].alias("score"), F.min("idx").alias("idx"), F.array_sort(F.collect_list(F.struct("idx", "chunk_id", F.round("first", 6).alias("s")))).alias("c"))
    grouped = best.select("group_key", "chunk_id", "score", F.transform("c", lambda x: x["chunk_id"]).alias("children"), F.transform("c", lambda x: x["s"]).alias("child_scores"), "idx")
    alone = keyed.filter("group_key IS NULL")
    single = alone.select("group_key", "chunk_id", "score", F.array("chunk_id").alias("children"), F.array(F.round("score", 6)).alias("child_scores"), "idx")
    return grouped.unionByName(single)


def by_score(hits: DataFrame) -> DataFrame:
    """The result of parents in its order: falling score; of equal scores single hits first, then by idx."""
    return hits.orderBy(F.desc("score"), F.col("group_key").isNotNull(), "idx")


def sufficiency(evidence: DataFrame, claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Score of each bundle: the weighted parts less the penalties, between 0 and 1.

    evidence(bundle_id, level, version_status, channel), claims(bundle_id, supported, missing), conflicts(bundle_id, kind).
    """
    level = F.element_at(F.create_map(*(F.lit(x) for kv in AUTHORITY.items() for x in kv)), F.col("level"))
    state = F.when(F.col("version_status") == "active", 1.0).when(F.col("version_status") == "superseded", 0.3).otherwise(0.5)
    e = evidence.groupBy("bundle_id").agg(F.avg(F.coalesce(level, F.lit(0.4))).alias("authority"), F.avg(state).alias("version"), F.count_distinct("channel").alias("channels"))
    c = claims.groupBy("bundle_id").agg(F.avg(F.col("supported").cast("int")).alias("coverage"), F.sum(F.col("missing").cast("int")).alias("missing"))
    weight = F.when(F.col("kind") == "authority", 0.15).when(F.col("kind") == "version", 0.10).when(F.col("kind") == "numeric", 0.12).otherwise(0.08)
    p = conflicts.groupBy("bundle_id").agg(F.sum(weight).alias("penalty"))
    joined = c.join(e, "bundle_id", "left").join(p, "bundle_id", "left").na.fill({"authority": 0.0, "version": 0.0, "channels": 0, "penalty": 0.0})
    channel = F.when(F.col("channels") >= 2, 1.0).when(F.col("channels") == 1, 0.7).otherwise(0.0)
    condition = F.greatest(F.lit(0.0), 1 - 0.15 * F.col("missing"))
    raw = 0.30 * F.col("coverage") + 0.15 * F.col("authority") + 0.20 * F.col("version") + 0.15 * condition + 0.20 * channel
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - F.col("penalty") - F.least(F.lit(MISSING_CAP), MISSING_PENALTY * F.col("missing"))))
    out = joined.withColumn("score", F.round(score, 6))
    return out.select("bundle_id", F.round("coverage", 6).alias("coverage"), F.round("authority", 6).alias("authority"), F.round("version", 6).alias("version"), "score", (F.col("score") >= SUFFICIENT).alias("sufficient"))


def mismatches(facts: DataFrame, by: str, value: str, least: int = 2) -> DataFrame:
    """Groups with at least `least` distinct values: numeric, temporal and (with levels) authority conflicts."""
    return facts.groupBy(by).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least_value"), F.max(value).alias("most_value")).filter(F.col("n_values") >= least)


def version_conflicts(evidence: DataFrame) -> DataFrame:
    """Documents whose evidence is both active and superseded, with more than one content."""
    both = evidence.groupBy("doc").agg(F.max((F.col("version_status") == "active").cast("int")).alias("a"), F.max((F.col("version_status") == "superseded").cast("int")).alias("s"), F.count_distinct("content").alias("n_contents"))
    return both.filter("a = 1 AND s = 1 AND n_contents > 1").select("doc", "n_contents")
