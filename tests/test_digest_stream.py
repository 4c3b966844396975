"""Kept digests equal the batch plan after shuffled, repeated and late files, and after cut-off triggers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daybook import schemas
from daybook.operators import history as oh
from daybook.plans import daily
from daybook.sources import dayswap
from daybook.streaming import flows
from daybook.streaming.digests import DigestStore, arrivals, keep_digests, read_digests

START = datetime(2024, 3, 1)


def activity(n=160, seed=3):
    """Commits of three authors (one null) over four days and a few undated ones, with up to three files each."""
    rnd = random.Random(seed)
    commits, files = [], []
    for seq in range(n):
        at = None if seq % 41 == 7 else START + timedelta(minutes=36 * seq)
        author = ("a@x.org", "a@x.org", "b@x.org", None)[rnd.randrange(4)]
        message = rnd.choice(["feat: add x", "fix: y", "wip", "merge branch 'z'", "tidy\n\nbody", ""])
        commits.append((seq, rnd.choice(["one", "two"]), f"{seq:040x}", author, at, 60, message))
        for pos in range(rnd.randrange(4)):
            files.append((seq, pos, f"src/m{pos}/f{seq}.py", f"src/m{pos}/f{seq}.py", rnd.randrange(9), rnd.randrange(9)))
    return commits, files


def in_order(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_kept_digests_equal_the_batch_plan(spark, tmp_path):
    commits, files = activity()
    rnd = random.Random(1)
    rnd.shuffle(commits)
    late = [f for f in files if f[0] % 5 == 0]
    early = [f for f in files if f[0] % 5]
    rnd.shuffle(early)
    c, f, root = (str(tmp_path / n) for n in ("c", "f", "kept"))

    def go():
        streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p) for s, p in ((schemas.COMMIT, c), (schemas.COMMIT_FILE, f))]
        query = keep_digests(*streams, root).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    def same():
        batch = daily.author_days(
            spark.read.schema(schemas.COMMIT).parquet(c).distinct(), spark.read.schema(schemas.COMMIT_FILE).parquet(f).distinct()
        )
        got = read_digests(spark, root)
        assert got.columns == batch.columns
        assert in_order(got) == in_order(batch)
        return got.count()

    put(spark, commits[:80], schemas.COMMIT, c)
    put(spark, early, schemas.COMMIT_FILE, f)  # also rows of commits that are yet to come
    go()
    first = same()
    put(spark, commits[80:] + commits[10:20], schemas.COMMIT, c)
    put(spark, late + early[:15], schemas.COMMIT_FILE, f)
    go()
    assert same() > first > 5
    put(spark, late, schemas.COMMIT_FILE, f)  # nothing but repeats
    go()
    same()


def test_only_touched_groups_are_computed(spark, tmp_path):
    commits, files = activity(60)
    store = DigestStore(str(tmp_path / "kept"))

    def take(batch, some_commits, some_files):
        rows = arrivals(spark.createDataFrame(some_commits, schemas.COMMIT), spark.createDataFrame(some_files, schemas.COMMIT_FILE))
        store.take(rows, batch)

    take(0, commits, [])
    seq = next(c[0] for c in commits if c[3] == "b@x.org" and c[4])
    take(1, [], [(seq, 0, "late/a.py", "late/a.py", 1, 1)])
    assert [r.author_email for r in store.touched(spark, 1).collect()] == ["b@x.org"]
    batch = daily.author_days(
        spark.createDataFrame(commits, schemas.COMMIT), spark.createDataFrame([(seq, 0, "late/a.py", "late/a.py", 1, 1)], schemas.COMMIT_FILE)
    )
    assert in_order(store.digests(spark).drop(dayswap.DAY)) == in_order(batch)
    take(2, [], [])  # a trigger without rows
    take(3, [], [(10**7, 0, "no/commit.py", "no/commit.py", 1, 1)])
    assert in_order(store.digests(spark).drop(dayswap.DAY)) == in_order(batch)


@pytest.mark.parametrize("point", ["store", "write", "finish"])
def test_a_trigger_cut_off_and_run_again(spark, tmp_path, monkeypatch, point):
    commits, files = activity(60)
    store = DigestStore(str(tmp_path / "kept"))
    tables = [spark.createDataFrame(r, s) for r, s in ((commits, schemas.COMMIT), (files, schemas.COMMIT_FILE))]
    store.take(arrivals(tables[0].filter("seq < 40"), tables[1].filter("seq < 20")), 0)
    before = in_order(store.digests(spark))
    second = arrivals(tables[0].filter("seq >= 40"), tables[1].filter("seq >= 20"))

    def cut_off(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        if point == "store":
            patch.setattr(DigestStore, "refresh", cut_off)
        elif point == "write":
            patch.setattr(dayswap.DaySwap, "commit", cut_off)
        else:
            patch.setattr(dayswap, "_finish", cut_off)
        with pytest.raises(RuntimeError, match="lost"):
            store.take(second, 1)
    if point != "finish":
        assert in_order(store.digests(spark)) == before
    store.take(second, 1)
    store.take(second, 1)
    assert in_order(store.digests(spark).drop(dayswap.DAY)) == in_order(daily.author_days(*tables))


REQUEST = "request INT, commit_hash STRING, tone STRING, provider STRING, requested_at TIMESTAMP_NTZ"


def test_streamed_reuse_equals_the_batch_lookup(spark, tmp_path):
    rnd = random.Random(2)
    asked = [(i, f"h{rnd.randrange(6)}", "casual", "local", START + timedelta(minutes=31 * i)) for i in range(150)]
    asked += [(500, None, "casual", "local", START + timedelta(hours=3)), (501, "h1", "casual", "local", None)]
    made = [
        (i, START + timedelta(minutes=97 * i), f"h{rnd.randrange(8)}", "local", "m", "casual", f"text {i}", "[]", 24, rnd.choice([None, 70]))
        for i in range(45)
    ]
    made += [(900, made[3][1], made[3][2], "local", "m", "casual", "tie", "[]", 24, 1)]  # same time: the higher id
    edge = START + timedelta(days=9)
    last_asked = [(999, "end", "casual", "local", edge)]
    last_made = [(9999, edge, "end", "local", "m", "casual", "end", "[]", 24, 1)]
    a, m = str(tmp_path / "asked"), str(tmp_path / "made")
    for half in (0, 1):
        put(spark, asked[half::2], REQUEST, a)
        put(spark, made[half::2], schemas.HISTORY, m)
    put(spark, asked[:4], REQUEST, a)  # delivered again
    batch = oh.find_reusable(spark.read.schema(REQUEST).parquet(a).distinct(), spark.read.schema(schemas.HISTORY).parquet(m))
    want = in_order(batch)
    put(spark, last_asked, REQUEST, a)
    put(spark, last_made, schemas.HISTORY, m)
    streams = [spark.readStream.schema(s).parquet(p) for s, p in ((REQUEST, a), (schemas.HISTORY, m))]
    query = (
        flows.find_reusable(*streams, lateness="5 days")
        .writeStream.format("memory")
        .queryName("reused")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    got = spark.table("reused")
    assert got.filter("hit").count() > 20 and got.filter("NOT hit").count() > 20
    assert set(got.columns) == set(batch.columns)
    assert in_order(got.filter("request <> 999")) == want
    rows_left = query.lastProgress["stateOperators"]
    assert sum(s["numRowsTotal"] for s in rows_left) <= 4  # the closed days' rows have left the state
