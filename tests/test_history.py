"""History and usage operators, and their tables on disk."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daybook.functions import commits as fc
from daybook.operators import history as oh
from daybook.operators import usage
from daybook.sources import tables

T0 = datetime(2026, 1, 1)
SCHEMA = (
    "id bigint, created_at timestamp_ntz, commit_hash string, provider string, model string, "
    "tone string, standup_text string, repos string, hours_lookback int, quality_score int"
)


def history(spark, rows):
    """Rows of (id, created_at, overrides)."""
    base = {
        "commit_hash": "h", "provider": "local", "model": "m", "tone": "casual",
        "standup_text": "t", "repos": "[]", "hours_lookback": 24, "quality_score": 1,
    }
    made = [(i, at, *{**base, **extra}.values()) for i, at, extra in rows]
    return spark.createDataFrame(made, SCHEMA)


def test_repos_decode(values_of):
    texts = ['["api", "web"]', "[]", "not valid json", '{"a": 1}', '["a"] tail', None, " [1, true] "]
    assert values_of(oh.decode_repos, texts) == [
        ["api", "web"], [], [], [], [], [], ["1", "true"],
    ]


def test_reuse_takes_the_newest_row_of_the_same_day(spark):
    h = history(
        spark,
        [
            (1, T0, {}),
            (2, T0 + timedelta(hours=2), {"standup_text": "second"}),
            (3, T0 + timedelta(hours=2), {"standup_text": "tie goes to the higher id"}),
            (4, T0 + timedelta(days=1), {"standup_text": "other day"}),
            (5, T0 + timedelta(hours=3), {"tone": "formal"}),
        ],
    )
    requests = spark.createDataFrame(
        [(1, "h", "casual", "local", T0), (2, "x", "casual", "local", T0), (3, "h", "formal", "cloud", T0)],
        "request_id int, commit_hash string, tone string, provider string, requested_at timestamp_ntz",
    )
    got = {r.request_id: (r.hit, r.history_id) for r in oh.find_reusable(requests, h).collect()}
    assert got == {1: (True, 3), 2: (False, None), 3: (False, None)}
    missing = oh.find_missing(requests, h)
    assert sorted(r.request_id for r in missing.collect()) == [2, 3]


def test_retention(spark):
    h = history(spark, [(i, T0 + timedelta(seconds=i // 2), {}) for i in range(370)])
    kept = [r.id for r in oh.keep_newest(h, ["provider"]).select("id").collect()]
    gone = [r.id for r in oh.beyond_ceiling(h, ["provider"]).select("id").collect()]
    assert sorted(kept) == list(range(5, 370)) and sorted(gone) == list(range(5))
    assert oh.deleted_counts(h, ["provider"]).first()["deleted"] == 5
    assert oh.deleted_counts(h.limit(365), ["provider"]).first()["deleted"] is None
    assert oh.beyond_ceiling(h.limit(365), ["provider"]).count() == 0


def test_listing_limit_is_held_to_its_range(spark):
    h = history(spark, [(i, T0, {}) for i in range(120)])
    assert [r.id for r in oh.newest(h, 2).collect()] == [119, 118]
    assert oh.newest(h, 0).count() == 1 and oh.newest(h, 999).count() == 100


def test_purge(spark):
    h = history(spark, [(1, T0, {}), (2, T0 + timedelta(days=9), {})])
    assert [r.id for r in oh.purge(h, T0 + timedelta(days=10), 5).collect()] == [2]
    assert [r.id for r in oh.purge(h, T0 + timedelta(days=10), 10).collect()] == [1, 2]
    assert oh.purge(h, T0).count() == 0


def test_purge_and_lookback_reach_the_file_scan(spark, tmp_path):
    history(spark, [(1, T0, {})]).write.parquet(str(tmp_path / "h"))
    plan = oh.purge(spark.read.parquet(str(tmp_path / "h")), T0, 5).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in text
    assert "ReadSchema: struct<id:bigint,created_at:timestamp_ntz>" in text


def test_staleness(spark):
    now = T0 + timedelta(hours=5)
    h = history(
        spark,
        [
            (1, now - timedelta(minutes=60), {"model": "edge"}),
            (2, now - timedelta(minutes=61), {"model": "old"}),
            (3, None, {"model": "timeless"}),
            *[(10 + i, now, {"model": "busy"}) for i in range(23)],
        ],
    )
    wanted = spark.createDataFrame(
        [("local", m) for m in ("edge", "old", "timeless", "never", "busy")],
        "provider string, model string",
    )
    got = {r.model: r.stale for r in oh.stale_keys(h, wanted, now).collect()}
    assert got == {"edge": False, "old": True, "timeless": True, "never": True, "busy": False}
    # only the 25 newest rows count
    later = h.unionByName(history(spark, [(50 + i, now, {"model": "busy"}) for i in range(5)]))
    assert {r.model: r.stale for r in oh.stale_keys(later, wanted, now).collect()}["edge"]


def test_tagged_names(spark):
    names = spark.createDataFrame([("m",), ("m:7b",), ("m:7b:q4",), ("mx:7b",)], "name string")
    wanted = spark.createDataFrame([("m",), ("m:7b",), ("m",)], "model string")
    got = sorted(map(tuple, oh.match_tagged_names(names, wanted).collect()))
    assert got == [("m", "m"), ("m", "m:7b"), ("m", "m:7b:q4"), ("m:7b", "m:7b"), ("m:7b", "m:7b:q4")]


def test_version_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "version int")
    assert oh.highest_version(empty).first()["version"] == 0


def test_history_on_disk(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = history(spark, [(1, T0, {"standup_text": "a\r\nb\0" + "x" * 5000}), (2, T0 + timedelta(days=1), {})])
    rows = rows.withColumns({"repos": F.array(F.lit("api")), "quality_score": F.lit(None).cast("int")})
    tables.append_history(rows, path)
    tables.append_history(rows.withColumn("id", F.col("id") + 10), path)
    back = oh.decode(tables.read_history(spark, path))
    first = back.filter("id = 1").first()
    assert back.count() == 4 and len(first.standup_text) == 4000
    assert first.standup_text.startswith("a\nb") and first.repos == ["api"] and first.quality_score == 0
    day = back.filter("created_date = date'2026-01-02'")
    assert sorted(r.id for r in day.collect()) == [2, 12]
    tables.rewrite_history(oh.keep_newest(tables.read_history(spark, path), ["provider"], 1), path + "-new")
    assert [r.id for r in tables.read_history(spark, path + "-new").collect()] == [12]


def test_old_files_without_the_score_column(spark, tmp_path):
    path = str(tmp_path / "h")
    old = history(spark, [(1, T0, {})]).drop("quality_score").withColumn("created_date", F.to_date("created_at"))
    old.write.partitionBy("created_date").parquet(path)
    assert tables.read_history(spark, path).first()["quality_score"] == 0


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, T0)], "call_id bigint, user_id bigint, ts timestamp_ntz")
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        writer = rows.write.option("header", "true")
        writer.format(fmt).save(path)
        assert [tuple(r) for r in tables.read_calls(spark, path, fmt).collect()] == [(1, 7, T0)]
    assert tables.read_calls(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(ValueError, match="format"):
        tables.read_calls(spark, "x", "xml")


def _calls(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz")


def test_usage_report(spark):
    now = datetime(2026, 1, 8, 10)
    rows = [(1, datetime(2026, 1, 8))] * 7 + [(1, datetime(2026, 1, 2))] + [(1, datetime(2025, 12, 1))]
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    got = {r.user_id: r for r in usage.report(users, _calls(spark, rows), now).collect()}
    assert got[1].spark == "▂     █" and got[1].total_7d == 8 and got[1].total_all == 9
    assert got[1].report.splitlines()[3] == "  2026-01-02: 1 call(s)"
    assert got[2].spark == " " * 7 and got[2].last_call == "Never" and got[2].total_all == 0
    assert len([x for x in got[2].report.splitlines() if "call(s)" in x]) == 7


def test_usage_prune(spark):
    now = datetime(2026, 3, 1, 10)
    days = [now - timedelta(days=d) for d in (0, 30, 31, 45)]
    per_day = usage.daily(_calls(spark, [(1, d) for d in days]))
    kept = sorted(r.day for r in usage.prune(per_day, now).collect())
    assert kept == [date(2026, 1, 30), date(2026, 3, 1)]


@pytest.mark.parametrize(
    "week,hours,configured,want",
    [(True, 5, 9, 168), (False, 5, 9, 5), (False, 0, 9, 9), (None, None, 0, 0), (False, None, None, 24)],
)
def test_lookback_hours(spark, week, hours, configured, want):
    df = spark.createDataFrame([(week, hours, configured)], "w boolean, h int, c int")
    assert df.select(fc.lookback_hours("w", "h", "c")).first()[0] == want


def test_retention_with_a_null_owner_loses_nothing(spark):
    rows = [(i, None if i < 5 else "u", datetime(2024, 1, 1, i)) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, owner string, created_at timestamp_ntz")
    kept = {r.id for r in oh.keep_newest(df, ["owner"], 2).collect()}
    gone = {r.id for r in oh.beyond_ceiling(df, ["owner"], 2).collect()}
    assert kept | gone == set(range(9)) and not kept & gone
    assert {r.owner: r.deleted for r in oh.deleted_counts(df, ["owner"], 2).collect()} == {None: 3, "u": 2}


def test_stored_days_are_pruned(spark, tmp_path):
    place = str(tmp_path / "history")
    rows = [(i, f"h{i}", "casual", "local", datetime(2024, 1, 1 + i), "t", 1) for i in range(6)]
    names = "id bigint, commit_hash string, tone string, provider string, created_at timestamp_ntz, standup_text string, quality_score int"
    df = spark.createDataFrame(rows, names)
    df.withColumn("created_date", F.to_date("created_at")).write.partitionBy("created_date").parquet(place)
    stored = spark.read.parquet(place)
    purged = oh.purge(stored, "2024-01-06 12:00:00", days=2)
    assert purged.count() == 2
    plan = purged._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    asked = spark.createDataFrame([("h3", "casual", "local", datetime(2024, 1, 4, 9))], "commit_hash string, tone string, provider string, requested_at timestamp_ntz")
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked")).filter("commit_hash = 'h3'")
    found = oh.find_reusable(asked, stored)
    assert [r.history_id for r in found.collect()] == [3]
    assert oh.find_missing(asked, stored).count() == 0
