"""Task graphs as tables: ready tasks, dependents, cancelled branches, layers, the outcome of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.rounds import settle

WAITING = ("pending", "ready")


def ready(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks(node, status) all of whose dependencies exist and are completed; edges(node, needs)."""
    done = tasks.filter("status = 'completed'").select(F.col("node").alias("needs"))
    blocked = edges.join(done, "needs", "left_anti").select("node")
    return tasks.filter("status = 'pending'").select("node").join(blocked, "node", "left_anti")


def dependents(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(node) that needs one of the given nodes directly."""
    return edges.join(of.select(F.col("node").alias("needs")).distinct(), "needs", "left_semi").select("node").distinct()


def cancelled(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): waiting tasks that a failed one keeps from running, directly or through other cancelled ones.

    A round goes one step further along the edges from the tasks cancelled last, and a task is cancelled once, so cycles
    end and a round's work is that of its own tasks.
    """
    waiting = tasks.filter(F.col("status").isin(*WAITING)).select("node")
    last, all_ = tasks.filter("status = 'failed'").select("node"), None
    while True:
        found = dependents(edges, last).join(waiting, "node", "left_semi")
        last = settle(found if all_ is None else found.join(all_, "node", "left_anti"))
        if last.isEmpty():
            return tasks.select("node").limit(0) if all_ is None else all_
        all_ = last if all_ is None else all_.unionByName(last)


def outcomes(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, outcome) of a run of tasks(node, result): a failure or a timeout stays with its task and cancels what needs it.

    result is what the task would give: ok, failed or timeout. A task below a failed one does not run, whatever it would give.
    """
    bad = tasks.select("node", F.when(F.col("result") == "ok", "pending").otherwise("failed").alias("status"))
    waiting = tasks.select("node", F.lit("pending").alias("status"))
    gone = cancelled(bad.filter("status = 'failed'").unionByName(waiting), edges).distinct().withColumn("_gone", F.lit(True))
    out = F.when(F.col("_gone"), "cancelled").when(F.col("result") == "ok", "completed").otherwise(F.col("result"))
    return tasks.join(gone, "node", "left").select("node", out.alias("outcome"))


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer): longest path from a node without dependencies. A cycle raises.

    edges(node, needs); dependencies on unknown nodes and on oneself are ignored. A round takes the nodes whose needs are
    all placed, and what is left is written for the next one; a round without any such node means a cycle.
    """
    left = settle(edges.filter("node <> needs").join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi").select("node", "needs").distinct())
    rest, done, layer = settle(nodes.select("node").distinct()), None, 0
    while not rest.isEmpty():
        now = settle(rest.join(left.select("node").distinct(), "node", "left_anti"))
        if now.isEmpty():
            raise ValueError("the dependencies form a cycle")
        placed = now.withColumn("layer", F.lit(layer))
        done = placed if done is None else done.unionByName(placed)
        rest = settle(rest.join(now, "node", "left_anti"))
        left = settle(left.join(now.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"))
        layer += 1
    return nodes.select("node", F.lit(0).alias("layer")).limit(0) if done is None else done
