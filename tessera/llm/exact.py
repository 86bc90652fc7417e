"""Exact deduplication by skew-safe combining.

Copies meet in three stages, and each compares whole contents, never digests alone:

1. within a task, Spark's map-side aggregation keeps one row per (digest, content);
2. what the tasks kept is merged per (digest, salt, content), where the salt comes from the task, so that a group with a
   third of all rows is spread over `salts` reducers (and has one row per task by then);
3. the winners of the salts, at most `salts` rows per content, are merged per (digest, content).

Members find their group through the digest in a join that adaptive execution may split when one digest is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stash, text_of


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest_bits: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays.

    * null text: empty text, so null and empty texts form one group;
    * null id: smaller than any id; a group of null ids only has a null keep_id and keeps one row;
    * repeated rows (same id and text): one of them is kept;
    * empty input: no rows. Other columns of the input, whatever their names, are not read.

    digest_bits cuts the digest used for grouping (tests force collisions with it); contents are still compared in full.
    """
    norm = ascii_lower(text_of(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    whole = F.sha2(F.col("norm").cast("binary"), 256)
    digest = F.unhex(F.substring(whole, 1, digest_bits // 4))

    tasks = base.select("doc_id", "norm", digest.alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = tasks.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = stash(merged.select("digest", F.unhex(whole).alias("sha"), "keep_id", "group_size"), "exact-groups")

    members = base.select("doc_id", digest.alias("digest"), F.unhex(whole).alias("sha"))
    members = members.groupBy("doc_id", "digest", "sha").agg(F.count(F.lit(1)).alias("m"))
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    if shared.isEmpty():  # the rule: a digest names one content
        found = members.join(groups.drop("sha"), "digest")
    else:
        # Digests of several contents: their members compare contents with the groups' own rows, one per content.
        plain, mixed = groups.join(shared, "digest", "left_anti"), groups.join(shared, "digest", "left_semi")
        contents = merged.join(shared, "digest", "left_semi").select("digest", "norm", F.col("keep_id"), "group_size")
        texts = base.select("doc_id", "norm", digest.alias("digest"), F.unhex(whole).alias("sha")).join(mixed.select("digest").distinct(), "digest", "left_semi")
        texts = texts.groupBy("doc_id", "digest", "sha", "norm").agg(F.count(F.lit(1)).alias("m"))
        found = members.join(plain.drop("sha"), "digest").unionByName(texts.join(contents, ["digest", "norm"]).drop("norm"))
    found = found.select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy"))
    return found.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""
