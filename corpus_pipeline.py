"""A corpus pipeline of five stages over `documents`, each stage one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir), with docs all rows its predecessor kept, and returns a DataFrame that the caller
writes and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, mixing, packing, simhash, toxicity
from tessera.llm.common import ascii_lower, stash, table, text_of, tidy
from tessera.llm.queries import CATEGORIES, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(rows: DataFrame, doc_id: str, *others: Column) -> DataFrame:
    """Rows with key columns that are never null, so that joins on them and groups by them need one shuffle together."""
    keys = {"_id": F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))}
    return rows.withColumns(keys | {f"_key{i}": c for i, c in enumerate(others)})


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject as toxic.

    Null and empty texts have no features and stay; very long texts count whole; null ids and repeated rows are judged
    like any other, so repeated rows stay or go together; no labels: all stay; empty table: no rows. Columns other than
    those of documents are dropped.
    """
    tidy(spark)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.score(docs, chain, keep=COLUMNS[1:])
    return scored.filter("NOT is_toxic").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z in lower case): that with the largest doc_id, and one of rows that repeat it.

    Null texts equal empty ones; null ids are smaller than any id; very long texts are compared whole; of rows with the
    same id and equal texts, ties in all else, any one stays; empty table: no rows.
    """
    tidy(spark)
    kept = exact.exact_groups(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    kept = _named(kept, "doc_id", F.col("sha")).select("_id", "_key0")
    own = _named(docs, "doc_id", _sha(ascii_lower(text_of("text"))))
    return own.join(kept, ["_id", "_key0"], "left_semi").dropDuplicates(["_id", "_key0"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each component of five-word shingle similarity >= 0.8, among candidates of SimHash: deletion variants up to two bits, beyond them shared bands of minimum hashes ranked by fingerprints.

    Rows are named by id and text, which the stage before made unique; of rows that repeat both, all or none stay. Null
    and empty texts are alike; very long texts are shingled whole; null ids come before all others; empty table: no rows.
    """
    tidy(spark)
    named = docs.withColumn("_row", F.struct("doc_id", _sha(text_of("text")).alias("sha")))
    groups = simhash.similar_groups(named, id_col="_row")
    first = groups.filter(F.col("_row") == F.col("component_id")).select("_row.doc_id", "_row.sha")
    first = _named(first, "doc_id", F.col("sha")).select("_id", "_key0")
    return _named(docs, "doc_id", _sha(text_of("text"))).join(first, ["_id", "_key0"], "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have size 0 and come with their source's ratio; a null source is a source of its own; rows of
    one id, source and size are taken equally often; very long texts may be taken or left whole only; empty table: no rows.
    """
    tidy(spark)
    source = lambda: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    taken = _named(mixing.mix_sources(docs).filter("copies > 0"), "doc_id", source(), F.col("size"))
    taken = taken.select("_id", "_key0", "_key1", F.col("copies").alias("_copies")).distinct()
    own = _named(docs, "doc_id", source(), F.regexp_count(text_of("text"), F.lit(mixing.WORD)).cast("long"))
    found = own.join(taken, ["_id", "_key0", "_key1"])
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, each from one document.

    Null and empty texts are one end token; very long texts are cut into as many pieces as needed; repeated rows (the mix
    makes them) and null ids are packed like any other; empty table: no rows.
    """
    tidy(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The classifier, the fingerprints, the sampling and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
