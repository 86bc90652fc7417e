"""Stateful folds as streams: equal to their batch forms over replayed events, however cut, and after a restart."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import states
from tessera.streaming import folds, stateful

SF = "/root/testdata/sf0.001"
NAMES = sorted(states.MOVES)


@pytest.fixture(scope="module")
def events(spark):
    """Events with many of one key and of one time; one far ahead lets the watermark pass all others."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", (F.col("user_id") % 5).alias("user_id"), F.date_trunc("hour", "ts").alias("ts"))
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))
    moves = F.element_at(F.array(*map(F.lit, [*NAMES, "NOWHERE"])), (F.pmod(F.xxhash64("event_id"), F.lit(len(NAMES) + 1)) + 1).cast("int"))
    return e.withColumn("user_id", hot).withColumn("state", moves).cache()


def replay(spark, events, fold, where, value=None, parts=3, stop_after=None):
    """The rows a stream writes when the events come in `parts` files by time; it may be stopped and started between two of them."""
    ordered = events.orderBy("ts", "event_id").collect()
    size = -(-len(ordered) // parts)
    last = ordered[-1].asDict()
    far = spark.createDataFrame([{**last, "user_id": -1, "event_id": -1, "ts": last["ts"].replace(year=last["ts"].year + 9)}], events.schema)

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
        out = stateful.fold_stream(stream, fold, value=value)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{where}/check").option("path", f"{where}/out").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert not q.isActive and q.exception() is None

    for i in range(parts):
        spark.createDataFrame(ordered[i * size : (i + 1) * size], events.schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        if stop_after == i:
            run()
    far.coalesce(1).write.mode("append").parquet(f"{where}/in")
    run()
    return spark.read.parquet(f"{where}/out")


def same(stream, batch, *columns):
    key = lambda df: sorted(map(tuple, df.select("user_id", "event_id", *columns).collect()))
    assert key(stream) == key(batch) and batch.count() > 0


def test_rate_limit_stream_equals_batch_after_a_restart(spark, events, tmp_path):
    limit = 2
    got = replay(spark, events, stateful.rate_limit(limit, 7200), f"file://{tmp_path}", stop_after=1)
    same(got, folds.rate_limit(events, limit, 7200), "allowed")
    assert got.filter("NOT allowed").count() > 0


def test_idempotent_stream_equals_batch(spark, events, tmp_path):
    got = replay(spark, events, stateful.idempotent(10_000), f"file://{tmp_path}", parts=2)
    same(got, folds.idempotent(events, 10_000), "stored")
    assert 0 < got.filter("stored").count() < got.count()


def test_machine_stream_equals_batch(spark, events, tmp_path):
    got = replay(spark, events, stateful.machine(), f"file://{tmp_path}", value="state", parts=2, stop_after=0)
    batch = states.replay(events.withColumn("at", F.struct("ts", "event_id")), "user_id", "at").select("user_id", "event_id", "state", "after", "accepted")
    same(got, batch, "state", "after", "accepted")
