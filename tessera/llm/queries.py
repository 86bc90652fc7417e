"""The operators as queries with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, decontamination, divergence, exact, html, maxent, mixing, packing, sharding, simhash, toxicity, warc
from .common import table

#: Categories that the labels tell, in the order of the chain. They have one of toxicity only; quality is the one before it.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; null text: the end id alone; any length of text; ties do not occur, repeated rows are packed each."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each page, read back; null html: empty; repeated rows: a record each; equal payloads: the largest page_id is the response."""
    pages = table(spark, sf_dir, "pages")
    found = warc.summary(warc.round_trip(pages))
    kind = pages.schema["page_id"].dataType
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id 20 divides; vectors that are null, zero or not finite take no part; ties go to the smaller id."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; null or empty text: fingerprint zero; texts of any length; repeated rows: each."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html: empty; pages of any length, broken or not; repeated rows: each."""
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; null text: size 0; null source: one of its own; ties by hash, so reruns agree."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots under the law `key`; null text: 8 bytes; null ids share a shard; repeated rows: a slot each."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 24).withColumn("law", F.lit("key"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; null text: empty; of repeated rows one is kept; texts of any length are compared whole."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain, fitted on at most 8,000 labelled documents, over all documents; null text: no features; repeated rows: each."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, chain).withColumnRenamed("is_toxic", "toxic").drop("is_low_quality")


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents; null text: the end token; texts of any length; repeated rows: each trains and is scored."""
    return maxent.score(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of all documents under two tokenizers; null, empty or not reproduced: zeros; ties: all best; repeated rows: each."""
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and terms of all documents by divergence; nulls: empty strings; ties: by item; repeated rows: each counts."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of benchmark items; null text: no words; ties: all items count; repeated rows: each."""
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_warc, op3_ann, op4_simhash, op5_html, op6_mixing, op7_sharding, op8_exact, op9_toxicity, op10_maxent, op11_alignment, op12_divergence, op13_decontamination)}
ORACLE_SQL = {"op2_warc": warc.ORACLE, "op8_exact": exact.ORACLE, "op12_divergence": divergence.ORACLE, "op13_decontamination": decontamination.ORACLE}
