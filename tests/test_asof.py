"""As-of joins against a loop over all versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import asof


@pytest.mark.parametrize("most", [1_000_000, 40, 3, 1])
def test_as_of_equals_loops(spark, most):
    r = random.Random(most)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    versions = [(key(), r.choice([None, *range(30)]), i, r.choice([None, *range(10, 60)])) for i in range(120)]
    asks = [(i, key(), r.choice([None, *range(-3, 40)])) for i in range(200)] + [(7, "hot", 12), (7, "hot", 12), (900, "new", 5)]
    plain = []
    for i, k, t in asks:
        some = [v for v in versions if k is not None and t is not None and v[0] == k and v[1] is not None and v[1] <= t]
        best = max(some, key=lambda v: (v[1], v[2]), default=None)
        plain.append((i, best and best[2], "not_yet_effective" if not best else "superseded" if best[3] is not None and t >= best[3] else "active"))
    left = spark.createDataFrame(asks, "ask long, k string, t int").withColumn("since", F.lit("clash"))
    right = spark.createDataFrame(versions, "k string, since int, vid long, until int").withColumn("t", F.lit("clash"))
    got = asof.as_of(left.repartition(3), right, ["k"], "t", "since", "until", tie="vid", most=most)
    assert got.columns == ["ask", "k", "t", "since", "version", "state"]
    assert sorted(((x.ask, x.version and x.version.vid, x.state) for x in got.collect()), key=repr) == sorted(plain, key=repr)


def test_no_range_join_in_the_plan(spark):
    left, right = spark.range(10).selectExpr("id AS k", "id AS t"), spark.range(10).selectExpr("id AS k", "id AS since", "id AS vid")
    plan = asof.as_of(left, right, ["k"], "t", "since")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert asof.as_of(left, right.limit(0), ["k"], "t", "since").filter("state = 'not_yet_effective'").count() == 10
    assert asof.as_of(left.limit(0), right, ["k"], "t", "since").count() == 0


@pytest.mark.parametrize(("status", "begin", "end", "content", "issue", "verdict"), [
    ("active", "2020-01-01", "", "", None, "ok"), ("Repealed", "2020-01-01", "", "", "repealed", "error"), ("已被替代", "2020年1月2日", None, "", "superseded", "warning"),
    ("odd", None, None, "x", "unknown_status", "warning"), (None, None, None, "自2031.2.3起", "not_yet_effective", "error"), ("superseded", "2020-01-01", "2025-06-01", "", "superseded_before_query", "error"),
    ("", "2030-01-01", None, "", None, "ok"),
])
def test_version_issues(spark, status, begin, end, content, issue, verdict):
    row = spark.createDataFrame([(status, begin, end, content)], "s string, b string, e string, c string")
    got = row.select(asof.version_issue(F.col("s"), F.col("b"), F.col("e"), F.col("c"), F.lit("2030年1月1日")).alias("v")).first().v
    assert (got.issue, got.verdict) == (issue, verdict)
