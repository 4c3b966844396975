"""In-place deletes of the history table: only touched days change, and all of them or none."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from daybook.operators import history as oh
from daybook.plans.maintenance import prune_history, purge_history
from daybook.sources import dayswap
from daybook.sources.tables import append_history, read_history

T0 = datetime(2026, 1, 1)
SCHEMA = (
    "id bigint, created_at timestamp_ntz, commit_hash string, provider string, model string, tone string, "
    "standup_text string, repos array<string>, hours_lookback int, quality_score int"
)


@pytest.fixture
def stored(spark, tmp_path):
    """A table of ten days: 'local' has rows on all of them, 'cloud' on the last three, one row has no time."""
    rnd = random.Random(4)
    rows = [(i, T0 + timedelta(hours=4 * i), "local") for i in range(60)]
    rows += [(100 + i, T0 + timedelta(days=7, hours=i), "cloud") for i in range(60)]
    rows += [(900, None, "local"), (901, T0 + timedelta(days=4, hours=1), "local")]
    rnd.shuffle(rows)
    made = [(i, at, "h", p, "m", "casual", f"text {i}", ["api"], 24, 7) for i, at, p in rows]
    path = str(tmp_path / "history")
    append_history(spark.createDataFrame(made, SCHEMA), path)
    return path


def rows_of(spark, path):
    return sorted((tuple(r) for r in read_history(spark, path).collect()), key=str)


def files_of(path):
    return {p.parent.name: p.name for p in Path(path).glob("created_date=*/*.parquet")}


def hidden(path):
    return [p.name for p in Path(path).iterdir() if p.name.startswith("_") and p.name != "_SUCCESS"]


@pytest.mark.parametrize("ceiling", [1, 20, 45, 61, 62, 500])
def test_retention_in_place_equals_the_rows_it_keeps(spark, stored, ceiling):
    before, files = rows_of(spark, stored), files_of(stored)
    want = sorted((tuple(r) for r in oh.keep_newest(read_history(spark, stored), ["provider"], ceiling).collect()), key=str)
    done = prune_history(spark, stored, ["provider"], ceiling)
    assert rows_of(spark, stored) == want
    gone = {str(r[-1]) if r[-1] else dayswap.NO_DAY for r in set(before) - set(want)}
    assert gone == {*done.rewritten, *done.dropped}
    for folder, name in files.items():  # other days keep their very files
        if folder.removeprefix("created_date=") not in gone:
            assert files_of(stored)[folder] == name
    assert hidden(stored) == []
    assert prune_history(spark, stored, ["provider"], ceiling) == ([], [])


def test_only_touched_days_are_read_for_rewriting(spark, stored):
    rows = read_history(spark, stored).filter(dayswap.in_days(["2026-01-02", "2026-01-04"]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [created_date" in plan and "DataFilters: []" in plan
    assert {str(r.created_date) for r in rows.collect()} == {"2026-01-02", "2026-01-04"}


def test_purge_reads_the_day_of_the_edge_only(spark, stored):
    for folder in Path(stored).glob("created_date=*"):
        if folder.name != "created_date=2026-01-05":  # would fail if they were read
            for file in folder.glob("*"):
                file.write_bytes(b"not parquet")
    now = T0 + timedelta(days=10, hours=2)
    done = purge_history(spark, stored, now, 6)
    assert done.rewritten == ["2026-01-05"]
    assert done.dropped == [f"2026-01-0{d}" for d in range(1, 5)] + [dayswap.NO_DAY]
    left = read_history(spark, stored).filter(dayswap.in_days(["2026-01-05"]))
    assert sorted(r.id for r in left.select("id").collect()) == [25, 26, 27, 28, 29]


@pytest.mark.parametrize(("hours", "days"), [(0, 6), (2, 6), (0, 0), (0, 400), (0, None)])
def test_purge_in_place_equals_the_rows_it_keeps(spark, stored, hours, days):
    now = T0 + timedelta(days=10, hours=hours)
    want = sorted((tuple(r) for r in oh.purge(read_history(spark, stored), now, days).collect()), key=str)
    purge_history(spark, stored, now, days)
    if want:
        assert rows_of(spark, stored) == want
    else:
        assert not list(Path(stored).glob("created_date=*"))
    assert hidden(stored) == []


class Killed(Exception):
    pass


def test_a_change_cut_off_before_its_commit_leaves_the_table(spark, stored, monkeypatch):
    before = rows_of(spark, stored)

    def die(self):
        raise Killed

    with monkeypatch.context() as patched:
        patched.setattr(dayswap.DaySwap, "commit", die)
        with pytest.raises(Killed):
            prune_history(spark, stored, ["provider"], 20)
    assert rows_of(spark, stored) == before and len(hidden(stored)) == 1
    dayswap.recover(spark, stored)
    assert rows_of(spark, stored) == before and hidden(stored) == []


@pytest.mark.parametrize("steps", range(0, 17, 2))
def test_a_change_cut_off_after_its_commit_is_ended(spark, stored, monkeypatch, steps):
    """However many deletes and renames were done, the next upkeep or ``recover`` ends the change."""
    want = sorted((tuple(r) for r in oh.keep_newest(read_history(spark, stored), ["provider"], 20).collect()), key=str)
    left = [steps]

    def counting(real):
        def step(self, *folders):
            if dayswap.COMMITTED in folders[-1] and real.__name__ == "rename":
                return real(self, *folders)  # the commit itself
            if not left[0]:
                raise Killed
            left[0] -= 1
            return real(self, *folders)

        return step

    with monkeypatch.context() as patched:
        for name in ("remove", "rename"):
            patched.setattr(dayswap._Files, name, counting(getattr(dayswap._Files, name)))
        try:
            prune_history(spark, stored, ["provider"], 20)
        except Killed:
            pass
    dayswap.recover(spark, stored)
    assert rows_of(spark, stored) == want and hidden(stored) == []


def test_rows_appended_meanwhile_stop_the_commit(spark, stored):
    change = dayswap.DaySwap(spark, stored)
    change.touch(["2026-01-03"])
    change.write(read_history(spark, stored).filter(dayswap.in_days(["2026-01-03"])).limit(1))
    late = [(999, T0 + timedelta(days=2), "h", "local", "m", "casual", "late", ["api"], 24, 7)]
    append_history(spark.createDataFrame(late, SCHEMA), stored)
    before = rows_of(spark, stored)
    with pytest.raises(dayswap.ChangedMeanwhile):
        change.commit()
    assert rows_of(spark, stored) == before
    change.abandon()
    assert hidden(stored) == []


def test_rows_of_untouched_days_are_refused(spark, stored):
    change = dayswap.DaySwap(spark, stored)
    change.touch(["2026-01-03"])
    change.write(read_history(spark, stored).filter(F.col("id") < 20))
    with pytest.raises(ValueError, match="not touched"):
        change.commit()
