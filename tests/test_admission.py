"""The admission rule against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from daybook.operators.admission import admit

START = datetime(2024, 1, 1)
SCHEMA = "user_id bigint, call_id bigint, ts timestamp_ntz"
FLAGGED = SCHEMA + ", forced boolean, ok boolean, done timestamp_ntz"


def plain_loop(rows, cooldown, cap):
    """Row after row, as the rule is told."""
    out = {}
    last, used = {}, {}
    for user, call, ts, forced, ok, done in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before, day = last.get(user), ts.date()
        wait = timedelta(minutes=cooldown) - (ts - before) if before else timedelta(0)
        if not forced and before and ts - before < timedelta(minutes=cooldown):
            out[call] = (False, "cooldown", int(wait.total_seconds()))
            continue
        if not forced and used.get((user, day), 0) >= cap:
            out[call] = (False, "daily", 0)
            continue
        out[call] = (True, "", 0)
        if ok:
            at = done or ts
            last[user] = at
            used[user, at.date()] = used.get((user, at.date()), 0) + 1
    return out


def decided(df):
    return {
        r.call_id: (r.admitted, r.reason, r.seconds_remaining) for r in df.collect()
    }


def calls(n, users, days, seed, flags=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rnd.random() < 0.5 else rnd.randrange(users)
        ts = START + timedelta(seconds=rnd.randrange(days * 86400))
        forced = flags and rnd.random() < 0.05
        ok = not flags or rnd.random() < 0.8
        done = ts + timedelta(minutes=rnd.randrange(90)) if flags and rnd.random() < 0.5 else None
        rows.append((user, i, ts, forced, ok, done))
    return rows


@pytest.mark.parametrize("cooldown,cap", [(30, 10), (0, 3), (240, 2), (1440, 1), (600, 50)])
def test_walk_equals_plain_loop(spark, cooldown, cap):
    rows = calls(800, 6, 6, seed=cooldown)
    df = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    assert decided(admit(df, cooldown, cap)) == plain_loop(rows, cooldown, cap)


@pytest.mark.parametrize("cooldown,cap", [(30, 4), (600, 2)])
def test_forced_failed_and_slow_calls(spark, cooldown, cap):
    rows = calls(600, 4, 5, seed=7, flags=True)
    df = spark.createDataFrame(rows, FLAGGED)
    got = admit(df, cooldown, cap, forced="forced", succeeded="ok", completed="done")
    assert decided(got) == plain_loop(rows, cooldown, cap)


@pytest.mark.parametrize("cooldown,cap", [(300, 3), (1440, 2), (12_000, 9)])
def test_one_user_with_all_rows(spark, cooldown, cap):
    rows = [(1, *r[1:]) for r in calls(500, 3, 40, seed=11, flags=True)]
    df = spark.createDataFrame(rows, FLAGGED)
    got = admit(df, cooldown, cap, forced="forced", succeeded="ok", completed="done")
    assert decided(got) == plain_loop(rows, cooldown, cap)


@pytest.mark.parametrize("column", ["enabled", "forced", "ok"])
def test_jobs_do_not_grow_with_free_or_failed_calls(spark, column):
    """Limits off, all forced, or all failed: as many jobs for 30 as for 3,000 calls of one user."""
    jobs = []
    for n in (30, 3000):
        rows = [(1, i, START + timedelta(seconds=150_000 * i // n), column == "forced") for i in range(n)]
        df = spark.createDataFrame(rows, f"{SCHEMA}, {column} boolean")
        spark.sparkContext.setJobGroup(f"{column}-{n}", "admission")
        named = {"ok": {"succeeded": "ok"}}.get(column, {column: column})
        out = admit(df, 120, 1, **named).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{column}-{n}")))
        assert all(r.admitted for r in out) and len(out) == n
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 4


def test_calls_without_a_time_or_user_are_refused_not_lost(spark):
    rows = [(1, 1, None), (1, 2, START), (None, 3, None), (None, 4, START), (1, 2, START)]
    got = sorted(((r.call_id, r.admitted, r.reason) for r in admit(spark.createDataFrame(rows, SCHEMA), 30, 10).collect()))
    assert got == [(1, False, "invalid"), (2, False, "cooldown"), (2, True, ""), (3, False, "invalid"), (4, False, "invalid")]


def test_exact_boundary_admits_and_ties_go_by_id(spark):
    rows = [(1, 1, START), (1, 3, START + timedelta(minutes=30)), (1, 2, START)]
    got = decided(admit(spark.createDataFrame(rows, SCHEMA), 30, 10))
    assert got == {1: (True, "", 0), 2: (False, "cooldown", 1800), 3: (True, "", 0)}


def test_zero_cooldown_always_admits_below_the_cap(spark):
    rows = [(1, i, START) for i in range(4)]
    got = decided(admit(spark.createDataFrame(rows, SCHEMA), 0, 3))
    assert [got[i][1] for i in range(4)] == ["", "", "", "daily"]


def test_disabled_limits_admit_everything(spark):
    rows = [(1, i, START, False) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA + ", enabled boolean")
    assert all(a for a, _, _ in decided(admit(df, 30, 1, enabled="enabled")).values())


def test_same_result_for_any_partitioning(spark):
    rows = calls(400, 5, 4, seed=3)
    df = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    assert decided(admit(df.coalesce(1), 30, 3)) == decided(admit(df.repartition(8), 30, 3))
