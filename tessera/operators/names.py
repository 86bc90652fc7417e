"""Names of documents and tables as people write them: aliases, beginnings, ends, keywords, common substrings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

# What file names end in, a document's number, an attachment's name, and who issues documents.
EXTENSIONS = r"(?i)\.(pdf|docx|xlsx|xls|doc|pptx)$"
NUMBERED = r"^\d{3}_"
ATTACHMENT = r"附件\s*([一二三四五六七八九十\d]+)\s*[：:]\s*(.+)"
ISSUERS = ("中国银保监会", "中国银保监会办公厅", "银保监会", "银保监会办公厅", "国家金融监督管理总局", "金融监管总局", "财政部", "财政部办公厅", "中国人民银行", "人民银行")
ISSUED = r"(?:办公厅)?(?:关于)?(?:印发)?_?"


def normal(name: Column) -> Column:
    """A name without file extension, full-width signs and spaces."""
    bare = F.regexp_replace(name, EXTENSIONS, "")
    return F.trim(F.replace(F.translate(bare, "：（）", ":()"), F.lit(" "), F.lit("")))


def aliases(name: Column) -> Column:
    """Other names of a document: as it is and normalised; without its number; without its issuer, too; its last part after an
    underscore; and of an attachment its number and title, and the title alone."""
    plain = normal(name)
    bare = F.regexp_replace(plain, NUMBERED, "")
    issuer = f"^(?:{'|'.join(ISSUERS)}){ISSUED}"
    number, title = (F.regexp_extract(name, f"(?U){ATTACHMENT}", i) for i in (1, 2))
    attached = F.when(number != "", F.concat(F.lit("附件"), number, F.lit("："), title)).otherwise("")
    return F.filter(F.array_distinct(F.array(name, plain, bare, F.regexp_replace(bare, issuer, ""), F.element_at(F.split(bare, "_"), -1), attached, title)), lambda a: a != "")


def resolve_documents(asked: DataFrame, names: DataFrame, least: int = 2, extra: DataFrame | None = None) -> DataFrame:
    """(ask_id, name_id, level) of the best name of each asked(ask_id, text), among names(name_id, name) and aliases extra(alias, name_id).

    Levels: 1 the same text; 2 an alias; 3 the name contains the text (a fourth level, the name's end, is part of it); 5 all
    of the text's keywords, two or more, are in the name. The lowest level wins, then the smaller name_id.

    Equal texts are asked once and equal names stand for their smallest name_id, as copies share a result. Names meet through
    pieces as long as some text, so only lengths that occur are cut, and a piece keeps its smallest name_id before it is
    joined. Keywords meet on that of a text which fewest names hold, and the others are looked up in the name.
    """
    texts = asked.filter(F.coalesce("text", F.lit("")) != "").select("text").distinct()
    a = texts.withColumn("plain", normal(F.col("text"))).filter("plain <> ''")
    n = names.groupBy("name").agg(F.min("name_id").alias("name_id")).withColumn("full", normal(F.col("name")))
    own = n.select("name_id", F.explode(aliases(F.col("name"))).alias("alias"))
    own = own if extra is None else own.unionByName(extra.select("name_id", normal(F.col("alias")).alias("alias")))
    own = own.groupBy(normal(F.col("alias")).alias("alias")).agg(F.min("name_id").alias("name_id"))
    same = a.join(n, F.col("text") == F.col("name")).select("text", "name_id", F.lit(1).alias("level"))
    known = a.join(own, F.col("plain") == F.col("alias")).select("text", "name_id", F.lit(2).alias("level"))
    inside = pieces(n, "full", a.select(F.length("plain").alias("size")).filter(F.col("size") >= least)).groupBy("piece").agg(F.min("name_id").alias("name_id"))
    inside = inside.join(a, F.col("piece") == F.col("plain")).select("text", "name_id", F.lit(3).alias("level"))
    sets = a.select("text", F.filter(F.array_distinct(F.split("text", r"[\s_\-:：()（）]+")), lambda w: F.length(w) >= 2).alias("words")).filter(F.size("words") >= 2)
    words = sets.select("text", "words", F.explode("words").alias("word"))
    held = pieces(n, "full", words.select(F.length("word").alias("size"))).select("name_id", "full", "piece").join(words.select(F.col("word").alias("piece")).distinct(), "piece", "left_semi")
    often = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(often, F.col("word") == F.col("piece"), "left").groupBy("text", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"))
    met = rarest.filter("r.n > 0").select("text", "words", F.col("r.word").alias("piece")).join(held, "piece")
    all_in = met.filter(F.forall("words", lambda w: F.contains(F.col("full"), w))).select("text", "name_id", F.lit(5).alias("level"))
    best = same.unionByName(known).unionByName(inside).unionByName(all_in).groupBy("text").agg(F.min(F.struct("level", "name_id")).alias("b"))
    return asked.select("ask_id", "text").join(best, "text").groupBy("ask_id").agg(F.min("b").alias("b")).select("ask_id", "b.name_id", "b.level")


def pieces(names: DataFrame, column: str, sizes: DataFrame) -> DataFrame:
    """names with a row for each distinct piece of the column that is as long as one of sizes(size)."""
    lengths = sizes.distinct()  # as many as texts have lengths
    starts = F.transform(F.sequence(F.lit(1), F.length(column) - F.col("size") + 1), lambda i: F.substr(F.col(column), i, F.col("size")))
    fits = names.join(F.broadcast(lengths), F.length(column) >= F.col("size"))
    return fits.withColumn("piece", F.explode(F.array_distinct(starts))).drop("size")


def table_name(name: Column) -> Column:
    """A table's name with half-width signs, single spaces and months without a leading zero, in lower case."""
    plain = F.regexp_replace(F.trim(F.translate(name, "（）　", "() ")), r"\s+", " ")
    return F.lower(F.regexp_replace(plain, r"0(\d)月", "$1月"))


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, by growing it from each place of the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    best = 0
    for i in range(len(a)):
        while i + best < len(a) and a[i : i + best + 1] in b:
            best += 1
    return best


@F.pandas_udf(DoubleType())
def _common_share(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(x, y) / max(1, min(len(x), len(y))) for x, y in zip(a, b, strict=True)])


def resolve_tables(asked: DataFrame, tables: DataFrame, accept: float = 0.4, sure: float = 0.5) -> DataFrame:
    """(ask_id, name, level, score) of the best table name for each asked(ask_id, text), among tables(name); asks without one are absent.

    1 the same text; 2 the same after normalisation; 3 one contains the other, scored by the shorter one's share of the
    longer; 4, where that is below `sure`, the longest common substring's share of the shorter one, unless both name years
    and the text one that the table does not. The best score over `accept` wins, then the smaller name.

    An accepted pair shares more than `accept` of the shorter name, so also a piece of the largest power of two within
    that length. The shorter name is cut into pieces of its own such length, the longer one into pieces of every power, and
    they meet on equal pieces.
    """
    a = asked.select("ask_id", "text", table_name(F.col("text")).alias("low")).filter("low <> ''")
    t = tables.select("name", table_name(F.col("name")).alias("own")).filter("own <> ''").distinct()

    def cut(c: str, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(F.col(c), i, size))

    def own_pieces(c: str) -> Column:
        needed = F.floor(F.length(c) * accept) + 1
        return F.explode(F.array_distinct(cut(c, F.pow(F.lit(2), F.floor(F.log2(needed))).cast("int"))))

    def all_pieces(c: str) -> Column:
        powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.length(c))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.explode(F.array_distinct(F.flatten(F.transform(powers, lambda p: cut(c, p)))))

    shorter = F.length("low") <= F.length("own")
    met = a.withColumn("g", own_pieces("low")).join(t.withColumn("g", all_pieces("own")), "g").filter(shorter)
    met = met.unionByName(a.withColumn("g", all_pieces("low")).join(t.withColumn("g", own_pieces("own")), "g").filter(~shorter))
    met = met.select("ask_id", "text", "low", "name", "own").distinct()
    ratio = F.when(F.contains("own", "low"), F.length("low") / F.length("own")).when(F.contains("low", "own"), F.length("own") / F.length("low"))
    years = lambda c: F.regexp_extract_all(c, F.lit(r"(\d{4})年"), F.lit(1))
    apart = (F.size(years("low")) > 0) & (F.size(years("own")) > 0) & (F.size(F.array_except(years("low"), years("own"))) > 0)
    scored = met.withColumn("ratio", ratio).withColumn("level", F.when(F.col("text") == F.col("name"), 1).when(F.col("low") == F.col("own"), 2))
    scored = scored.withColumn("whole", F.max("ratio").over(Window.partitionBy("ask_id")))
    common = F.when((F.coalesce("whole", F.lit(0.0)) < sure) & ~apart, _common_share(F.col("low"), F.col("own")))
    level = F.coalesce("level", F.when(F.col("ratio") >= F.coalesce("common", F.lit(0.0)), 3), F.when(F.col("common").isNotNull(), 4))
    score = F.when(F.col("level") <= 2, 1.0).otherwise(F.greatest(F.coalesce("ratio", F.lit(0.0)), F.coalesce("common", F.lit(0.0))))
    out = scored.withColumn("common", common).select("ask_id", "name", level.alias("at"), score.alias("score")).filter((F.col("at") <= 2) | (F.col("score") > accept))
    nth = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.when(F.col("at") <= 2, F.col("at")).otherwise(3), F.desc("score"), "name"))
    return out.withColumn("nth", nth).filter("nth = 1").select("ask_id", "name", F.col("at").alias("level"), F.round("score", 6).alias("score"))
