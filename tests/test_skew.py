"""One key with a third of all rows must not end in one task."""

import pytest
from pyspark.sql import functions as F

from daybook.operators import commits as oc
from daybook.operators import history as oh

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
}


@pytest.fixture
def tight(spark):
    """Limits small enough to show on small data what happens on big data."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df):
    summed = df.agg(F.sum(F.hash(*df.columns)))
    summed.collect()
    return summed._jdf.queryExecution().executedPlan().toString()


def _hot(spark, n):
    third = F.col("id") % 3 == 0
    text = F.col("id").cast("string")
    return spark.range(0, n, 1, 8).select(
        "id", F.when(third, "hot").otherwise(F.md5(text)).alias("key"), F.sha2(text, 512).alias("pay")
    )


def _requests(spark):
    return _hot(spark, 200_000).select(
        F.col("id").alias("request_id"),
        F.col("key").alias("commit_hash"),
        F.substring("pay", 1, 0).alias("tone"),
        F.lit("p").alias("provider"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("requested_at"),
        "pay",
    )


def _history(spark):
    return _hot(spark, 50_000).select(
        "id",
        F.col("key").alias("commit_hash"),
        F.substring("pay", 1, 0).alias("tone"),
        F.lit("p").alias("provider"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        F.lit("t").alias("standup_text"),
        F.lit(1).alias("quality_score"),
    )


def test_reuse_lookup_splits_a_hot_key(tight):
    found = oh.find_reusable(_requests(tight), _history(tight))
    assert "skew=true" in _final_plan(found)
    assert found.count() == 200_000
    assert found.filter("hit and commit_hash = 'hot'").count() == 66_667


def test_missing_requests_split_a_hot_key(tight):
    history = _history(tight).filter("commit_hash <> 'hot'")
    assert "skew=true" in _final_plan(oh.find_missing(_requests(tight), history))


def test_strict_walk_splits_a_hot_repository(tight):
    at = F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    walk = _hot(tight, 200_000).select(
        F.col("key").alias("repo"), F.col("id").alias("seq"), at.alias("committed_at"), "pay"
    )
    out = oc.lookback_strict_walk(walk, "2024-01-01 00:00:30", 0)
    assert "skew=true" in _final_plan(out)


def test_totals_spread_a_hot_run_over_its_modules(tight):
    rows = _hot(tight, 30_000).select(
        "key",
        F.lit(1).alias("insertions"),
        F.lit(1).alias("deletions"),
        F.array((F.col("id") % 7).cast("string"), F.lit("m")).alias("modules"),
    )
    hot = oc.totals(rows, ["key"]).filter("key = 'hot'").first()
    assert (hot.commits, hot.insertions, len(hot.modules)) == (10_000, 10_000, 8)
