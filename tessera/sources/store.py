"""Document stores on files: exports of documents and chunks, summaries, golden sets, caches by content, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "doc_id string, doc_name string, doc_title string, parser_type string, source_file string, parse_timestamp string"
GOLDEN = "query_id string, query string, relevant array<string>, difficulty string, category string"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all *_summary.json under a path with the stem of their file, to be paired with chunk files."""
    rows = spark.read.schema(SUMMARY).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_summary.json").json(path)
    return rows.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)_summary\.json$", 1))


def pair(summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document rows that have chunks (both with a stem); a missing parse_timestamp comes from the first chunk's metadata."""
    first = chunks.groupBy("stem").agg(F.min_by(F.element_at("metadata", "parse_timestamp"), "chunk_id").alias("first_stamp"), F.count(F.lit(1)).alias("n_chunks"))
    stamp = F.coalesce(F.nullif("parse_timestamp", F.lit("")), F.col("first_stamp"))
    return summaries.join(first, "stem").withColumn("parse_timestamp", stamp).drop("first_stamp")


def replace_rows(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Insert or replace: a replaced row takes the new row's place, so it moves behind all older rows."""
    top = old.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_top"))
    moved = new.join(F.broadcast(top), F.lit(True)).withColumn(seq, F.col(seq) + F.col("_top")).drop("_top")
    last = moved.groupBy(key).agg(F.max_by(F.struct("*"), seq).alias("r")).select("r.*")
    return old.join(last, key, "left_anti").unionByName(last)


def type_counts(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, types): the summary of each document, types as a map from chunk type to count."""
    each = chunks.groupBy("doc_id", "chunk_type").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_chunks"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_type", "n")))).alias("types"))


def export_documents(chunks: DataFrame, path: str) -> None:
    """A folder of JSON lines for each document, and one table of summaries beside them."""
    chunks.repartition("doc_id").write.partitionBy("doc_id").mode("overwrite").json(f"{path}/chunks")
    type_counts(chunks).write.mode("overwrite").json(f"{path}/summaries")


def export_tables(docs: DataFrame, chunks: DataFrame, path: str, layout: str = "json") -> None:
    docs.write.mode("overwrite").format(layout).save(f"{path}/documents")
    chunks.write.mode("overwrite").format(layout).save(f"{path}/chunks")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item) pairs of a golden set, one for each relevant item."""
    return spark.read.schema(GOLDEN).json(path).select("query_id", F.explode("relevant").alias("item"))


def content_key(rows: DataFrame, *columns: str) -> str:
    """A key of a table's content whatever the order of its rows: counts and two sums of row hashes, one row to the driver."""
    h = F.xxhash64(*columns)
    r = rows.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return "-".join(str(v if v is not None else 0) for v in r)


def cached(spark: SparkSession, build, key: str, folder: str) -> DataFrame:
    """The table kept under a key, built and written only if it is not there yet (a finished write has _SUCCESS)."""
    target = f"{folder}/{key}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each named rule; a rule that gives null counts as broken. One pass over the rows."""
    sums = rows.agg(*(F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0)).alias(n) for n, c in rules.items()))
    cells = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules))
    return sums.select(F.explode(cells).alias("r")).select("r.*")
