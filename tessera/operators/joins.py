"""Joins whose conditions are no equality, turned into equality joins on pieces and verified: names, scopes, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import gazetteer


def overlapping_scopes(rows: DataFrame, doc: str, scope: str) -> DataFrame:
    """(scope, inside, n_docs, n_inside): pairs of scope classes, the second equal to or contained in the first.

    Rows of a class are counted, not paired: any two documents of an overlapping pair of classes conflict. A class
    overlaps itself if it has at least two documents. Null and empty scopes take no part.
    """
    classes = rows.filter(F.col(scope) != "").groupBy(F.col(scope).alias("scope")).agg(F.count_distinct(doc).alias("n_docs")).withColumn("low", F.lower("scope"))
    inner = classes.select(F.col("scope").alias("inside"), F.col("n_docs").alias("n_inside"), F.col("low").alias("name"))
    met = gazetteer.occurrences(classes, ["scope", "n_docs"], "low", classes, "low").join(inner, "name")
    return met.filter((F.col("scope") != F.col("inside")) | (F.col("n_docs") > 1)).select("scope", "inside", "n_docs", "n_inside")


def resolve_names(asked: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(ask_id, name_id, level) of the best name for each asked text; asks that no name meets are absent.

    asked(ask_id, text), names(name_id, name). Levels: 1 the same text, 2 the same but for case, 3 the name contains the
    text, 4 the text contains the name (both of at least `least` characters). Ties go to the smaller name_id.
    """
    a = asked.select("ask_id", F.trim("text").alias("text")).withColumn("low", F.lower("text"))
    n = names.select("name_id", "name", F.lower("name").alias("name_low"))
    same = a.join(n, F.col("low") == F.col("name_low")).select("ask_id", "name_id", F.when(F.col("text") == F.col("name"), 1).otherwise(2).alias("level"))
    asks, known = a.filter(F.length("low") >= least), n.filter(F.length("name_low") >= least)
    within = gazetteer.occurrences(n, ["name_id"], "name_low", asks, "low").join(asks, F.col("name") == F.col("low")).select("ask_id", "name_id", F.lit(3).alias("level"))
    around = gazetteer.occurrences(a, ["ask_id"], "low", known, "name_low").join(known.drop("name"), F.col("name") == F.col("name_low")).select("ask_id", "name_id", F.lit(4).alias("level"))
    best = same.unionByName(within).unionByName(around).groupBy("ask_id").agg(F.min(F.struct("level", "name_id")).alias("b"))
    return best.select("ask_id", "b.name_id", "b.level")


def unmatched_numbers(claims: DataFrame, evidence: DataFrame, by: str, tolerance: float = 0.01) -> DataFrame:
    """Claims' numbers that no number of the same group's evidence meets within the tolerance.

    claims(by, claim_id, value), evidence(by, value). Numbers meet in bins twice the tolerance wide, a claim looking
    into its own bin and both neighbours, so that the range condition is an equality join with a check. A null number or group is unmatched.
    """
    bin_of = lambda c: F.floor(c / (2 * tolerance))
    known = evidence.select(F.col(by), F.col("value").alias("known"), bin_of(F.col("value")).alias("bin")).distinct()
    wanted = claims.select(by, "claim_id", "value", F.explode(F.array(*(bin_of(F.col("value")) + d for d in (-1, 0, 1)))).alias("bin"))
    met = wanted.join(known, [by, "bin"]).filter(F.abs(F.col("value") - F.col("known")) <= tolerance).select(by, "claim_id", "value").distinct()
    return claims.join(met, [by, "claim_id", "value"], "left_anti")


def bind_claims(slots: DataFrame, evidence: DataFrame, most: int = 3, least_chars: int = 2) -> DataFrame:
    """(claim_id, evidence_id, rank, fallback): the first `most` evidence rows by id that share a word with the slot.

    A slot without any takes the first evidence row of all, marked as fallback (one row, so it may go to all tasks).
    """
    from tessera.functions.scalars import tokens

    words = lambda c: F.explode(F.array_distinct(tokens(F.col(c)))).alias("word")
    wanted = slots.select("claim_id", words("description")).filter(F.length("word") >= least_chars)
    # Only the first `most` evidence rows that have a word can be among a slot's first ones, so a common word meets few rows.
    nth = F.row_number().over(Window.partitionBy("word").orderBy("evidence_id"))
    held = evidence.select("evidence_id", words("content")).withColumn("nth", nth).filter(F.col("nth") <= most)
    met = held.join(wanted, "word").select("claim_id", "evidence_id").distinct()
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy("evidence_id"))
    bound = met.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("fallback", F.lit(False))
    first = evidence.agg(F.min("evidence_id").alias("evidence_id")).filter("evidence_id IS NOT NULL")
    rest = slots.select("claim_id").join(bound, "claim_id", "left_anti").join(F.broadcast(first), F.lit(True))
    return bound.unionByName(rest.select("claim_id", "evidence_id", F.lit(1).alias("rank"), F.lit(True).alias("fallback")))


def merge_branches(hits: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Best row of each key over all branches, the first by order on ties; rows with a null key are all kept."""
    named = hits.filter(F.col(key).isNotNull())
    best = named.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(F.col(score), -F.col(order))).alias("r")).select("r.*")
    return best.unionByName(hits.filter(F.col(key).isNull()))


def dedup_conflicts(conflicts: DataFrame) -> DataFrame:
    """conflicts(idx, kind, ids array): the first by idx of each kind and set of ids, whatever their order."""
    best = conflicts.withColumn("ids", F.array_sort(F.array_distinct("ids"))).groupBy("kind", "ids").agg(F.min("idx").alias("idx"))
    return best.select("idx", "kind", "ids")
