"""Retrieval branches as tables: which pending ones to cancel, and the context of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# When evidence suffices, and when a single exact hit does.
SUFFICIENT, EXACT_SCORE = 0.85, 0.8


def cancel(branches: DataFrame, hits: DataFrame, scores: DataFrame) -> DataFrame:
    """branches(request_id, channel, status) with an action: cancel, or keep.

    hits(request_id, channel, parent_id, score), scores(request_id, sufficiency). The first rule that holds decides:
    evidence suffices: all pending ones go; the completed exact branch has one hit of score 0.8 or more: dense and
    relation go; lexical and dense share a parent: table goes. Only launched and running branches are cancelled.
    """
    exact = hits.filter("channel = 'exact'").groupBy("request_id").agg((F.count(F.lit(1)) == 1).alias("one"), F.max("score").alias("best"))
    done = branches.filter("channel = 'exact' AND status = 'completed'").select("request_id").distinct()
    unique = exact.join(done, "request_id", "left_semi").filter(F.col("one") & (F.col("best") >= EXACT_SCORE)).select("request_id", F.lit(True).alias("unique"))
    kinds = hits.filter("channel IN ('lexical', 'dense') AND parent_id IS NOT NULL").groupBy("request_id", "parent_id").agg(F.count_distinct("channel").alias("n"))
    shared = kinds.filter("n = 2").select("request_id").distinct().withColumn("shared", F.lit(True))
    each = branches.join(scores, "request_id", "left").join(unique, "request_id", "left").join(shared, "request_id", "left")
    unique_, shared_ = F.coalesce("unique", F.lit(False)), F.coalesce("shared", F.lit(False))
    goes = F.when(F.coalesce("sufficiency", F.lit(0.0)) >= SUFFICIENT, True).when(unique_, F.col("channel").isin("dense", "relation")).when(shared_, F.col("channel") == "table").otherwise(False)
    action = F.when(goes & F.col("status").isin("launched", "running"), "cancel").otherwise("keep")
    return each.select("request_id", "channel", "status", action.alias("action"))


def session_context(turns: DataFrame, facts: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, last_turn, recent, n_facts): the last turns of each session, joined in order, and its number of facts."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    recent = turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    each = recent.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    n = facts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_facts"))
    shown = F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
    return each.join(n, "conv_id", "left").select("conv_id", "last_turn", shown.alias("recent"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))

