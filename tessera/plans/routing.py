"""Plans as tables: routing by rules, plan costs and choice, task layers, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Latency in ms and success rate of each channel in the cost model, and the price of rerank.
CHANNELS = {"exact": (50, 0.95), "lexical": (100, 0.85), "dense": (200, 0.80), "metadata": (30, 0.99), "table": (150, 0.90), "relation": (300, 0.75)}
RERANK_MS = 500
LOST_GAIN_MS, LOST_SUCCESS_MS = 200, 500


def plan_costs(stages: DataFrame) -> DataFrame:
    """(plan_id, latency, gain, success, cost) of plans of rows (plan_id, stage, channel, latency, success, gain, rerank).

    A stage lasts as long as its slowest channel and its rerank; a plan as long as its stages together. Gains combine as
    1 - product(1 - gain), successes as a product; cost = latency + 200 (1 - gain) + 500 (1 - success).
    """
    s = stages.groupBy("plan_id", "stage").agg((F.max("latency") + F.max(F.when(F.col("rerank"), RERANK_MS).otherwise(0))).alias("lat"), F.product(1 - F.col("gain")).alias("miss"), F.product("success").alias("ok"))
    p = s.groupBy("plan_id").agg(F.sum("lat").alias("latency"), (1 - F.product("miss")).alias("gain"), F.product("ok").alias("success"))
    cost = F.col("latency") + LOST_GAIN_MS * (1 - F.col("gain")) + LOST_SUCCESS_MS * (1 - F.col("success"))
    return p.select("plan_id", F.col("latency").cast("long").alias("latency"), F.round("gain", 6).alias("gain"), F.round("success", 6).alias("success"), F.round(cost, 4).alias("cost"))


def budget_actions(spend: DataFrame, limit: float, by: str, order: str, cost: str) -> DataFrame:
    """Running spend of each group and what it calls for: over the limit stop, from 80 % downgrade, else continue."""
    used = F.sum(cost).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    action = F.when(F.col("used") > limit, "stop").when(F.col("used") >= 0.8 * limit, "downgrade").otherwise("continue")
    return spend.withColumn("used", used).withColumn("action", action)
