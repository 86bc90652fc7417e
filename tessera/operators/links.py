"""Links between chunks: neighbours, parents, siblings, windows; joins with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def auto_link(chunks: DataFrame, order: tuple[str, ...] = ("pos",), row: str = "chunk_id") -> DataFrame:
    """prev_id and next_id in the order of a document's chunks: one window pass. Links that are there already (not null, not '') stay.

    order names columns that are compared as whole numbers, such as clause and subclause numbers; a text that is none counts
    as 0. Ties go by `row`, the order of insertion.
    """
    w = Window.partitionBy("doc_id").orderBy(*(F.coalesce(F.col(c).try_cast("long"), F.lit(0)) for c in order), row)
    kind = chunks.schema["chunk_id"].dataType

    def filled(name: str, found: Column) -> Column:
        if name not in chunks.columns:
            return found
        return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")).cast(kind), found)

    return chunks.withColumns({"prev_id": filled("prev_id", F.lag("chunk_id").over(w)), "next_id": filled("next_id", F.lead("chunk_id").over(w))})


def walk(chunks: DataFrame, ids: DataFrame, window: int = 2) -> DataFrame:
    """(chunk_id, distance, near_id) along the stored links prev_id and next_id; a link to nothing, or none, ends the walk.

    One equality join a step and side, window being small.
    """
    here = chunks.select("chunk_id", "prev_id", "next_id")
    start = ids.select("chunk_id").join(here.select("chunk_id"), "chunk_id", "left_semi").distinct()
    out = start.select("chunk_id", F.lit(0).alias("distance"), F.col("chunk_id").alias("near_id"))
    for column, sign in (("prev_id", -1), ("next_id", 1)):
        link = here.select(F.col("chunk_id").alias("at"), F.col(column).alias("to")).filter("to IS NOT NULL").join(here.select(F.col("chunk_id").alias("to")), "to", "left_semi")
        now = start.select("chunk_id", F.col("chunk_id").alias("at"))
        for step in range(1, window + 1):
            now = now.join(link, "at").select("chunk_id", F.col("to").alias("at"))
            out = out.unionByName(now.select("chunk_id", F.lit(sign * step).alias("distance"), F.col("at").alias("near_id")))
    return out


def bundles(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, chunk, parent, prev, next, children, siblings): the neighbourhood of the given chunks(chunk_id, parent_id, prev_id, next_id, content).

    Children and siblings (itself included) are ids in order; a root's siblings are the document's other roots.
    """
    own = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "doc_id", "parent_id", "prev_id", "next_id", F.col("content").alias("chunk"))
    for name in ("parent", "prev", "next"):
        other = chunks.select(F.col("chunk_id").alias(f"{name}_id"), F.col("content").alias(name))
        own = own.join(other, f"{name}_id", "left")
    under = chunks.groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("kin"))  # as long as one parent has children
    kids = under.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("_of"), F.col("kin").alias("children"))
    own = own.join(kids, F.col("chunk_id") == F.col("_of"), "left").drop("_of")
    same = under.select(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent"), F.col("kin").alias("siblings"))
    own = own.join(same, (F.col("doc_id") == F.col("_doc")) & F.col("parent_id").eqNullSafe(F.col("_parent")), "left")
    return own.select("chunk_id", "chunk", "parent", "prev", "next", F.coalesce("children", F.expr("filter(siblings, x -> false)")).alias("children"), "siblings")


def surrounding(chunks: DataFrame, ids: DataFrame, window: int = 2) -> DataFrame:
    """(chunk_id, distance, near_id): chunks at most `window` places away from the given ones in their document, on either side.

    Where all links are there this is the walk along them; places are numbered once, so that no self-join a step is needed.
    """
    w = Window.partitionBy("doc_id").orderBy("pos", "chunk_id")
    placed = chunks.select("chunk_id", "doc_id", F.row_number().over(w).alias("at"))
    wanted = placed.join(ids.select("chunk_id"), "chunk_id").select("chunk_id", "doc_id", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("distance"), "at")
    wanted = wanted.withColumn("at", F.col("at") + F.col("distance"))
    near = placed.withColumnRenamed("chunk_id", "near_id")
    return wanted.join(near, ["doc_id", "at"]).select("chunk_id", "distance", "near_id")


def children(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_children, first_child, last_child): children of the root that each document is."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_children"), F.min("chunk_id").alias("first_child"), F.max("chunk_id").alias("last_child"))


def with_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """LEFT equi-join of chunks to their documents."""
    return chunks.join(docs.select("doc_id", F.col("n_chars").alias("doc_chars")), "doc_id", "left")


def siblings(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks under the same parent as the given ones, themselves included."""
    mine = chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "doc_id")
    return mine.join(chunks.select("doc_id", F.col("chunk_id").alias("sibling_id")), "doc_id").select("chunk_id", "sibling_id")


def latest(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """The latest row of each group by a list of columns, as one grouped maximum."""
    best = rows.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return best.select(by, "r.*")
