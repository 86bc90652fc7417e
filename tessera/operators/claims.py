"""Claims: planning from templates, slot filling, verification of citations, versions and sentences; memory of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rules
from tessera.functions.scalars import tokens


def fill_slots(slots: DataFrame, evidence: DataFrame, most: int = 3, least_chars: int = 2) -> DataFrame:
    """(claim_id, evidence_id, rank): the `most` best evidence rows that share a keyword with a slot.

    Keywords are words of the slot's description of at least least_chars characters; they meet the evidence's words in
    an equality join, so no pair without a common word is looked at. Ties in score go to the smaller evidence id.
    """
    wanted = slots.select("claim_id", F.explode(F.array_distinct(tokens(F.col("description")))).alias("word")).filter(F.length("word") >= least_chars)
    words = evidence.select("evidence_id", "score", F.explode(F.array_distinct(tokens(F.col("content")))).alias("word"))
    # Of the evidence that has a word only the `most` best can be among a slot's best, so a common word meets few rows.
    nth = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "evidence_id"))
    words = words.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")
    met = words.join(wanted, "word").groupBy("claim_id", "evidence_id").agg(F.first("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), "evidence_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).select("claim_id", "evidence_id", "rank")


def slot_status(slots: DataFrame, filled: DataFrame) -> DataFrame:
    """supported where evidence was found, else missing (required) or pending (optional)."""
    got = filled.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, "supported").when(F.col("required"), "missing").otherwise("pending")
    return slots.join(got, "claim_id", "left").select("claim_id", state.alias("status"))


def check_citations(answers: DataFrame) -> DataFrame:
    """answers(answer_id, text, n_evidence): how many citations there are, which numbers or ranges are out of range, and how many sources are named."""
    beyond = rules.cited_beyond(F.col("text"), F.col("n_evidence"))
    n = F.size(rules.cited_within(F.col("text"), F.col("n_evidence"))) + F.size(beyond)
    return answers.select("answer_id", n.alias("n_cited"), F.array_join(beyond, ",").alias("out_of_range"), F.size(rules.cited_names(F.col("text"))).alias("n_named"))


def check_versions(evidence: DataFrame, asked: str = "asked", effective: str = "effective", superseded: str = "superseded", status: str | None = None) -> DataFrame:
    """Verdict of each row: error if repealed (by a status column) or not in force at the asked date, warning if superseded since, else ok."""
    repealed = F.lit(False) if status is None else F.coalesce(F.col(status) == "repealed", F.lit(False))
    verdict = F.when(repealed, "error").when(F.col(effective) > F.col(asked), "error").when(F.col(superseded) <= F.col(asked), "error").when(F.col(superseded).isNotNull(), "warning").otherwise("ok")
    return evidence.withColumn("verdict", verdict)


def check_sentences(answers: DataFrame, evidence: DataFrame, share: float = 0.3, hits: int = 2, shortest: int = 5) -> DataFrame:
    """(answer_id, n, unsupported, verdict): sentences whose words the answer's evidence does not have.

    A sentence is supported if at least `share` of its distinct words, or `hits` of them, occur in its evidence.
    Refuse if more than half are unsupported, retry if some are, else accept.
    """
    s = answers.select("answer_id", F.posexplode(F.split("text", r"[.!?。！？\n]")).alias("pos", "sentence")).filter(F.length(F.trim("sentence")) >= shortest)
    words = s.select("answer_id", "pos", F.explode_outer(F.array_distinct(tokens(F.col("sentence")))).alias("word"))
    known = evidence.select("answer_id", F.explode(tokens(F.col("content"))).alias("word")).distinct().withColumn("hit", F.lit(1))
    each = words.join(known, ["answer_id", "word"], "left").groupBy("answer_id", "pos").agg(F.count("word").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("h"))
    bad = each.withColumn("bad", (~((F.col("h") >= hits) | (F.col("h") >= share * F.greatest(F.col("n"), F.lit(1))))).cast("int"))
    total = bad.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("unsupported"))
    verdict = F.when(F.col("unsupported") > F.floor(F.col("n") / 2), "refuse").when(F.col("unsupported") > 0, "retry").otherwise("accept")
    return total.withColumn("verdict", verdict)


def summaries(turns: DataFrame, every: int = 5) -> DataFrame:
    """A summary row at every `every`-th turn over the last `every` turns: their number and total length."""
    w = Window.partitionBy("conv_id").orderBy("at").rowsBetween(-(every - 1), 0)
    at = turns.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    out = at.withColumn("n_turns", F.count(F.lit(1)).over(w)).withColumn("n_chars", F.sum(F.length("text")).over(w))
    return out.filter(F.col("at") % every == 0).select("conv_id", "at", "n_turns", "n_chars")


def citations_numbered(hits: DataFrame, by: str, order: str, source: str) -> DataFrame:
    """(by, source, number): distinct sources of each answer, numbered from 1 by first occurrence."""
    first = hits.groupBy(by, source).agg(F.min(order).alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("first", source))).drop("first")
