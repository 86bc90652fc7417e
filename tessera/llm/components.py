"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equality join that adaptive execution may split, so
a vertex with a third of all links is no bottleneck. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scoped, stash


#: Vertices whose least neighbours go to all tasks; more are joined by a shuffle.
SENT = 500_000


def _star(edges: DataFrame, small: bool, sent: bool) -> DataFrame:
    """Link each vertex's larger neighbours (small: its smaller ones and itself) to the least vertex around it; links may repeat."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = near.join(F.broadcast(least) if sent else least, "u")
    if small:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b")


@scoped
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every vertex of edges(a, b): component is the least vertex reachable.

    Null ends are left out, loops and repeated edges change nothing, an empty table gives no rows.
    """
    now = stash(edges.select("a", "b").dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size, seen = now.count(), None
    sent = 2 * size <= SENT  # an edge has two vertices, and rounds add none
    for _ in range(rounds if size else 0):
        now = stash(_star(_star(now, False, sent), True, sent).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if state == seen:
            break
        seen = state
    else:
        if size:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """label(node, component) after more edges(a, b): components are joined as the vertices that they now are."""
    a, b = label.toDF("a", "ca"), label.toDF("b", "cb")
    across = edges.select("a", "b").dropna().join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    more = components(across)
    into = more.select(F.col("node").alias("component"), F.col("component").alias("_into"))
    old = label.join(into, "component", "left").select("node", F.coalesce("_into", "component").alias("component"))
    fresh = more.join(label.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    return stash(old.unionByName(fresh).distinct(), "label")
