"""Readers: the driver's tables, chunk files and their sinks. Schemas are explicit; nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_FIELDS = "chunk_id string, chunk_type string, content string, hierarchy_path string, source_file string, doc_id string, doc_name string, doc_title string, metadata map<string,string>"
SKIPPED_TYPES = ("cell_fact", "formula")
#: Chunk ids are a document's id times this, plus the line: more lines than an array can hold, so no two chunks share one.
LINES = 1 << 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_chunk_lines(spark: SparkSession, path: str, skip: tuple[str, ...] = SKIPPED_TYPES) -> DataFrame:
    """Chunks of all *_chunks.jsonl under a path; malformed and blank lines are dropped, unwanted types filtered."""
    rows = spark.read.schema(CHUNK_FIELDS).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_chunks.jsonl").json(path)
    return rows.filter(F.col("chunk_type").isNull() | ~F.col("chunk_type").isin(*skip))


def read_chunk_documents(spark: SparkSession, path: str, skip: tuple[str, ...] = SKIPPED_TYPES) -> DataFrame:
    """Chunks of *_chunks.json files: a list, an object with a list under "chunks", or one object."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_chunks.json").text(path)
    one = f"struct<{CHUNK_FIELDS.replace(' ', ':').replace(',:', ',')}>"
    listed = F.from_json("value", f"array<{one}>")
    nested = F.from_json("value", f"struct<chunks:array<{one}>>")["chunks"]
    single = F.array(F.from_json("value", one))
    found = F.when(F.ltrim("value").startswith("["), listed).when(nested.isNotNull(), nested).otherwise(single)
    rows = text.select(F.explode(found).alias("c")).filter("c IS NOT NULL").select("c.*")
    return rows.filter(F.col("chunk_type").isNull() | ~F.col("chunk_type").isin(*skip))


def lines_as_chunks(docs: DataFrame) -> DataFrame:
    """Non-blank lines of documents as chunks (chunk_id, doc_id, pos, content, source, lang). Document ids from 2^31 on are an error, not a wrong id."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    return lines.filter(F.trim("content") != "").select((F.col("doc_id").cast("long") * LINES + F.col("pos")).alias("chunk_id"), "doc_id", "pos", "content", "source", "lang")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both tables, the later one (by order, new before old on ties) for each key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(order, "_new")).alias("r"))
    return best.select("r.*").drop("_new")


def write_chunks(chunks: DataFrame, path: str, by: str = "doc_id") -> None:
    """One folder of JSON lines for each document; rows are dealt by document first, so that a folder has one file."""
    chunks.repartition(by).write.partitionBy(by).mode("overwrite").json(path)


def wide_vectors(vectors: DataFrame, size: int, vector: str = "embedding") -> DataFrame:
    """The vector as columns emb_0 .. emb_{size-1}, for column stores that know no arrays."""
    return vectors.select("vec_id", "label", *(F.get(vector, i).alias(f"emb_{i}") for i in range(size)))
