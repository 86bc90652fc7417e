"""Retrieval metrics, counters, histograms and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Macro averages over the queries with relevant rows: recall, precision and NDCG at each k, and MRR, to 4 digits.

    hits(query_id, item, rank), relevant(query_id, item). Precision divides by k even if there are fewer hits.
    """
    size = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    return _averages(size, hits.filter(F.col("rank") <= max(ks)).join(relevant, ["query_id", "item"]), ks)


def class_metrics(hits: DataFrame, classes: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """ranking_metrics where the relevant rows of a query are all others of its class; these are counted, never paired.

    hits(query_id, item, rank) without the query itself, classes(item, class), queries(query_id, class); null classes have no others.
    """
    sizes = classes.groupBy("class").agg((F.count(F.lit(1)) - 1).alias("n_rel"))
    size = queries.join(sizes, "class").filter("n_rel > 0").select("query_id", "n_rel")
    near = hits.filter(F.col("rank") <= max(ks)).join(classes, "item").join(queries.withColumnRenamed("class", "_own"), "query_id")
    return _averages(size, near.filter(F.col("class") == F.col("_own")), ks)


def _averages(size: DataFrame, good: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The averages from size(query_id, n_rel) and the relevant hits good(query_id, rank)."""
    got = good.groupBy("query_id").agg(F.min("rank").alias("first"), *(F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks), *(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"g{k}") for k in ks))
    q = size.join(got, "query_id", "left").na.fill(0)

    def ideal(k: int):
        return F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))

    out = [F.round(F.avg(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0)), 4).alias("mrr"), F.count(F.lit(1)).alias("n_queries")]
    for k in ks:
        out += [F.round(F.avg(F.col(f"h{k}") / F.col("n_rel")), 4).alias(f"recall_{k}"), F.round(F.avg(F.col(f"h{k}") / k), 4).alias(f"precision_{k}"), F.round(F.avg(F.col(f"g{k}") / ideal(k)), 4).alias(f"ndcg_{k}")]
    return q.agg(*out)


def cumulative_histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], by: str) -> DataFrame:
    """(by, bound, n, total): how many values are at most each bound. One pass: the bounds are aggregates, unpivoted."""
    cells = rows.groupBy(by).agg(*(F.sum((F.col(value) <= b).cast("int")).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(F.lit(1)).alias("total"))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").cast("long").alias("n")) for i, b in enumerate(bounds)))
    return cells.select(by, F.explode(pairs).alias("c"), "total").select(by, "c.bound", "c.n", "total")


def histogram_percentile(histogram: DataFrame, by: str, share: float) -> DataFrame:
    """The least bound under which the share of all values lies; the last bound if they lie beyond all; 0 without values."""
    met = F.min(F.when(F.col("n") >= F.lit(share) * F.col("total"), F.col("bound")))
    return histogram.groupBy(by).agg(F.when(F.max("total") > 0, F.coalesce(met, F.max("bound"))).otherwise(0.0).alias("percentile"))


def summed_histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], by: str) -> DataFrame:
    """(by, total, sum, avg) beside the counts of cumulative_histogram."""
    return rows.groupBy(by).agg(F.count(value).alias("total"), F.round(F.sum(value), 6).alias("sum"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("avg"), *(F.sum((F.col(value) <= b).cast("int")).alias(f"le_{i}") for i, b in enumerate(bounds)))


def latency_stats(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, extremes and the values at sorted places floor(n / 2) and floor(0.95 n) of each group.

    Null values do not count. Approximate quantiles, merged from all tasks, enclose each place; one more pass counts what
    lies below and keeps the few values between, and only these are sorted.
    """
    shares, near, accuracy = (0.5, 0.95), 0.001, 10_000
    known = rows.select(by, value).filter(F.col(value).isNotNull())
    ends = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-near, near)]
    facts = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.percentile_approx(value, ends, accuracy).alias("ends")
    )
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col("n") * s).alias("place"), F.get("ends", F.lit(2 * i)).alias("lo"), F.get("ends", F.lit(2 * i + 1)).alias("hi")) for i, s in enumerate(shares)))
    wanted = facts.select(F.col(by).alias("_by"), F.explode(each).alias("w")).select("_by", "w.*")
    # Equal values are one row with their number, so that a value which a third of the rows have is sorted once.
    counted = known.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    met = counted.join(wanted, counted[by].eqNullSafe(F.col("_by"))).filter(F.col(value) <= F.col("hi"))
    below = F.when(F.col(value) < F.col("lo"), F.lit(None).cast(rows.schema[value].dataType)).otherwise(F.col(value))
    steps = met.withColumn("v", below).groupBy("_by", "i", "place", "v").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_by", "i").orderBy(F.asc_nulls_first("v")))
    found = steps.withColumn("upto", upto).filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
    picked = found.groupBy("_by").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(("p50", "p95"))))
    return facts.join(picked, facts[by].eqNullSafe(F.col("_by"))).select(by, "mean", "least", "most", "p50", "p95")
