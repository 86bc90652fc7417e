"""Markdown tables: parsing, an index over same-named tables, columns, rows and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = r"^[\s|:-]+$"


def parse(chunks: DataFrame) -> DataFrame:
    """(table_id, chunk_id, row_index, headers, cells) of chunks(table_id, chunk_id, content).

    A table needs at least two lines with a pipe. Its header is the pipe line before the last separator line, else the
    first pipe line; separator lines are dropped. Same-named tables are appended by chunk_id, the first header wins.
    Missing cells are ''; row_index starts at 0. Rows are numbered within their chunk, and chunks by how many rows are before
    them, so that a task holds a chunk's rows, never a table's.
    """
    lines = chunks.withColumn("lines", F.filter(F.split("content", "\n"), lambda x: x.contains("|"))).filter(F.size("lines") >= 2)
    marks = F.transform("lines", lambda x: x.rlike(SEPARATOR))
    last = F.size("lines") - F.array_position(F.reverse(marks), True) + 1
    head = F.when(F.array_contains(marks, True) & (last > 1), last - 1).otherwise(1)
    split = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    placed = lines.withColumn("head", head.cast("int")).select("table_id", "chunk_id", split(F.element_at("lines", F.col("head"))).alias("headers"), F.expr("slice(lines, head + 1, size(lines))").alias("body"))
    body = placed.withColumn("body", F.filter("body", lambda x: ~x.rlike(SEPARATOR))).filter(F.size("body") > 0)
    rows = body.select("table_id", "chunk_id", F.posexplode("body").alias("pos", "line"))  # the body itself goes no further
    names = body.select(F.col("table_id").alias("_table"), F.col("chunk_id").alias("_chunk"), F.size("body").cast("long").alias("n"), F.col("headers").alias("_headers"))
    sizes = names.groupBy("_table", "_chunk").agg(F.sum("n").alias("n"), F.min("_headers").alias("_headers"))
    w = Window.partitionBy("_table").orderBy("_chunk")
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_headers", F.first("_headers").over(w))
    nth = F.row_number().over(Window.partitionBy("table_id", "chunk_id").orderBy("pos")) - 1
    rows = rows.withColumn("nth", nth).join(sizes, F.col("table_id").eqNullSafe(F.col("_table")) & F.col("chunk_id").eqNullSafe(F.col("_chunk")))
    rows = rows.select("table_id", "chunk_id", (F.col("before") + F.col("nth")).cast("int").alias("row_index"), F.col("_headers").alias("headers"), "line")
    cells = F.transform(F.col("headers"), lambda h, i: F.coalesce(F.get(split(F.col("line")), i), F.lit("")))
    return rows.select("table_id", "chunk_id", "row_index", "headers", cells.alias("cells"))


def column(table: DataFrame, name: str) -> DataFrame:
    """(table_id, row_index, value) of the first column whose header contains the name, regardless of case."""
    at = F.array_position(F.transform("headers", lambda h: F.lower(h).contains(name.lower())), True)
    return table.withColumn("at", at.cast("int")).filter("at > 0").select("table_id", "row_index", F.element_at("cells", F.col("at")).alias("value"))


def as_maps(table: DataFrame) -> DataFrame:
    """Rows as maps from header to cell; of equal headers the last wins."""
    pairs = F.reverse(F.arrays_zip(F.col("headers").alias("k"), F.col("cells").alias("v")))
    kept = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return table.select("table_id", "row_index", F.map_from_entries(kept).alias("row"))


def info(table: DataFrame) -> DataFrame:
    """(table_id, n_rows, n_columns) of every table."""
    return table.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("headers")).alias("n_columns"))


def find_rows(table: DataFrame, pattern: str, name: str | None = None) -> DataFrame:
    """Rows whose cells, joined by spaces, or whose named column contain the pattern, regardless of case."""
    text = F.array_join("cells", " ") if name is None else F.element_at("cells", F.array_position(F.transform("headers", lambda h: F.lower(h).contains(name.lower())), True).cast("int"))
    return table.filter(F.lower(text).contains(pattern.lower()))
