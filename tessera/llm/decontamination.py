"""Benchmark decontamination as a prefix-filtered set join of shingles, with DataFrame functions only.

A window is `window` consecutive words of an item (a shorter item is one window), and the set of its shingles of `shingle`
words. A document holds a window if it holds all of its shingles, each at its place, so a containment of 1 is asked for:
the necessary prefix of a window is its one rarest shingle.

1. Every shingle of the documents that occurs in any window is found, by hash and then by its words. These hits, distinct
   by content, position and shingle, are written.
2. Shingles are ordered by their hits. A window with a shingle that has none is nowhere. The others are joined on their
   rarest shingle, and where it stands gives the window's place: it must begin and end within the content (positional and
   length bounds).
3. A candidate is verified exactly by hits of the shingles that cover the window, at their places.

Contents are named by their digests, so copies are joined once. Item lists are made once per set of windows that some
content holds, not per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stash, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Shingles of the items that go to every task; more are joined by a shuffle.
SENT = 200_000


def _words(text: Column) -> Column:
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _content(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _places(size: Column, window: int) -> Column:
    """Where the windows of an item of so many words begin, from 0."""
    return F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: window_id, words, size, items (the sorted ids, as strings, of the items that hold it)."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _words(text_of(text_col)).alias("all"))
    own = own.filter(F.size("all") > 0).withColumn("at", F.explode(_places(F.size("all"), window)))
    own = own.select("item", F.slice("all", F.col("at") + 1, window).alias("words"))
    own = own.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return stash(own.select(F.monotonically_increasing_id().alias("window_id"), "words", F.size("words").alias("size"), "items"), "windows")


def _hits(docs: DataFrame, shingles: DataFrame, widths: list[int], text_col: str, sent: int) -> DataFrame:
    """Where contents hold the shingles: content, n_words, pos, sid; each once, however many copies a content has."""
    longest = max(widths)
    rows = docs.select(_content(text_of(text_col)).alias("content"), _words(text_of(text_col)).alias("all"))
    rows = rows.select("content", "all", F.posexplode_outer("all").alias("pos", "w0"))
    rows = rows.filter("w0 IS NOT NULL").select("content", F.size("all").alias("n_words"), "pos", "w0", *(F.get("all", F.col("pos") + i).alias(f"w{i}") for i in range(1, longest)))

    def key(width: int) -> Column:
        whole = F.col("pos") + width <= F.col("n_words")
        return F.struct(F.lit(width).alias("width"), F.when(whole, F.xxhash64(*(f"w{i}" for i in range(width)))).alias("h"))

    if len(widths) == 1:
        keyed = rows.withColumn("k", key(widths[0]))
    else:  # items shorter than a shingle: their length is looked up, too
        keyed = rows.withColumn("k", F.explode(F.array(*map(key, widths))))
    keyed = keyed.select("content", "n_words", "pos", F.col("k.h").alias("h"), F.col("k.width").alias("width"), *(f"w{i}" for i in range(longest)))
    known = shingles.select("sid", F.col("h").alias("known_h"), F.size("words").alias("known_width"), *(F.get("words", F.lit(i)).alias(f"known_{i}") for i in range(longest)))
    same = (F.col("h") == F.col("known_h")) & (F.col("width") == F.col("known_width"))
    for i in range(longest):
        same &= F.col(f"w{i}").eqNullSafe(F.col(f"known_{i}")) | (F.col("known_width") <= i)
    known = F.broadcast(known) if shingles.count() <= sent else known
    return stash(keyed.join(known, same).groupBy("content", "pos", "sid").agg(F.max("n_words").alias("n_words")), "hits")


def _prefixes(windows: DataFrame, parts: DataFrame, hits: DataFrame) -> DataFrame:
    """The windows all of whose shingles occur: their size, items' class, rarest shingle and its place, and the shingles that cover them."""
    counted = parts.join(hits.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "sid", "left")
    covers = (F.col("at") % F.col("width") == 0) | (F.col("at") + F.col("width") == F.col("size"))
    return (
        counted.groupBy("window_id", "size")
        .agg(
            F.min(F.coalesce("n", F.lit(0))).alias("least"),
            F.min(F.struct("n", "sid", "at")).alias("rarest"),
            F.collect_list(F.when(covers, F.struct("at", "sid"))).alias("cover"),
        )
        .filter("least > 0")
        .join(windows.select("window_id", "class"), "window_id")
        .select("window_id", "size", "class", F.col("rarest.sid").alias("sid"), F.col("rarest.at").alias("rare_at"), "cover")
    )


def _occurrences(hits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Windows in contents, verified: content, start, size, class."""
    found = hits.join(prefixes, "sid").withColumn("start", F.col("pos") - F.col("rare_at"))
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    needed = found.select("content", "start", "size", "class", "window_id", F.size("cover").alias("asked"), F.explode("cover").alias("c"))
    needed = needed.select("content", "start", "size", "class", "window_id", "asked", (F.col("start") + F.col("c.at")).alias("pos"), F.col("c.sid").alias("sid"))
    held = needed.join(hits.select("content", "pos", "sid"), ["content", "pos", "sid"])
    return held.groupBy("content", "start", "window_id", "size", "class", "asked").count().filter("count = asked").select("content", "start", "size", "class")


def _item_lists(sets: DataFrame, windows: DataFrame) -> DataFrame:
    """For each distinct set of classes the number of items and the digest of their list."""
    items = windows.select("class", "items").dropDuplicates(["class"])
    each = sets.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(items, "class")
    listed = each.groupBy("classes").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return listed.select("classes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", sent: int = SENT
) -> DataFrame:
    """A row a document: id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    * null and empty texts have no words; an item without words has no window; an item of fewer words than `window` is one;
    * very long texts count whole; repeated rows and null ids: a row each; ties (windows or items that are alike) all count;
    * items of one id are one item, and a null id is written as the empty string;
    * no documents: no rows; no items: nothing is contaminated. Other columns of either table are not read.
    """
    if not 0 < shingle <= window:
        raise ValueError("a shingle has at most as many words as a window")
    content = _content(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), content.alias("content"), F.regexp_count(text_of(text_col), F.lit(ANY_CASE)).cast("long").alias("n_words"))

    windows = item_windows(items, window, item_col, item_text)
    classes = windows.groupBy("items").agg(F.min("window_id").alias("class"))
    windows = stash(windows.join(classes, "items"), "window-classes")
    width = F.least("size", F.lit(shingle))
    parts = windows.withColumn("width", width).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))))
    parts = parts.select("window_id", "size", "width", "at", F.expr("slice(words, at + 1, width)").alias("part"))
    shingles = parts.select(F.col("part").alias("words")).distinct()
    hashed = [F.when(F.size("words") == k, F.xxhash64(*(F.get("words", F.lit(i)) for i in range(k)))) for k in range(1, shingle + 1)]
    shingles = stash(shingles.select(F.monotonically_increasing_id().alias("sid"), "words", F.coalesce(*hashed).alias("h")), "shingles")
    widths = sorted(r[0] for r in shingles.select(F.size("words")).distinct().collect())  # at most `shingle` numbers
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    order = [F.col("doc_id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")]
    if not widths:
        return rows.withColumns(none).select(*order)

    parts = parts.join(shingles.select("sid", F.col("words").alias("part")), "part").drop("part")
    hits = _hits(docs, shingles, widths, text_col, sent)
    found = _occurrences(hits, _prefixes(windows, parts, hits))
    end, before = F.col("start") + F.col("size"), Window.partitionBy("content").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    sets = found.withColumn("fresh", fresh).groupBy("content").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("class")).alias("classes"))
    sets = stash(sets, "contaminated")
    told = sets.join(_item_lists(sets, windows), "classes").drop("classes")
    out = rows.join(told, "content", "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()}).select(*order)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT row, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
      FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
o AS (SELECT DISTINCT row, n, s, item_id FROM p JOIN v USING (n, t)),
h AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS q FROM o) GROUP BY row),
l AS (SELECT row, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT coalesce(CAST(item_id AS VARCHAR), ''))), ',') AS items FROM o GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN l USING (row)
"""
