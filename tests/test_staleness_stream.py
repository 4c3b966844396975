"""The stream of stale keys tells, at each watermark, what the batch form says of the rows so far."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daybook.operators.history import stale_keys
from daybook.streaming.admission import use_state_store
from daybook.streaming.staleness import key_changes, stale_now

START = datetime(2024, 3, 1)
SCHEMA = "id bigint, user_id bigint, provider string, model string, created_at timestamp"


@pytest.fixture
def feed(spark, tmp_path):
    """Add rows as a file, let the stream catch up, return (rows so far, changes so far, watermark)."""
    use_state_store(spark)
    source, told, state = (str(tmp_path / n) for n in ("in", "told", "state"))

    def go(rows, owner=("user_id",)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = (
            key_changes(stream, owner, lateness="30 minutes")
            .writeStream.format("parquet")
            .option("path", told)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(180)
        assert query.exception() is None
        mark = query.lastProgress["eventTime"]["watermark"]
        return spark.read.schema(SCHEMA).parquet(source), spark.read.parquet(told), datetime.fromisoformat(mark[:-1])

    return go


def _shown(df, *names):
    return sorted(map(tuple, df.select(*names, "last_used", "stale").collect()), key=str)


def test_equal_to_batch_at_each_watermark(spark, feed):
    rnd = random.Random(3)
    wanted = spark.createDataFrame(
        [(u, p, f"m{m}") for u in range(4) for p in ("local", "cloud") for m in range(4)] + [(None, "local", "m0"), (1, None, "m1")],
        "user_id bigint, provider string, model string",
    )
    names = ("user_id", "provider", "model")
    at, i, seen = START, 0, set()
    for step in range(5):
        rows = []
        for _ in range(60):
            at += timedelta(seconds=rnd.randrange(1, 240))
            i += 1
            user = 1 if rnd.random() < 0.5 else rnd.choice([0, 2, 3, None])
            early = at - timedelta(minutes=rnd.randrange(25))
            rows.append((i, user, rnd.choice(["local", "cloud", None]), f"m{min(3, int(rnd.expovariate(1)))}", early))
        rows += [(9000 + step, 1, "local", "m0", None), rows[-1]]
        rnd.shuffle(rows)
        if step == 3:
            at += timedelta(hours=3)
            rows.append((8000, 3, "cloud", "m3", at))
        so_far, changes, mark = feed(rows)
        want = stale_keys(so_far, wanted, mark, owner=["user_id"])
        got = stale_now(changes, wanted, ["user_id"])
        assert _shown(got, *names) == _shown(want, *names)
        seen |= {(r.stale, r.last_used is None) for r in got.collect()}
    assert seen == {(True, True), (True, False), (False, False)}


def test_exact_edge_and_no_owner(spark, feed):
    """A use exactly an hour before the watermark is fresh, one a microsecond older is not."""
    edge = START + timedelta(hours=2)
    rows = [
        (1, 1, "local", "edge", edge - timedelta(hours=1)),
        (2, 2, "local", "older", edge - timedelta(hours=1, microseconds=1)),
        (3, 3, "local", "mover", edge + timedelta(minutes=30)),
    ]
    wanted = spark.createDataFrame([("local", m) for m in ("edge", "older", "mover", "never")], "provider string, model string")
    so_far, changes, mark = feed(rows, owner=())
    assert mark == edge
    got = stale_now(changes, wanted)
    assert {r.model: r.stale for r in got.collect()} == {"edge": False, "older": True, "mover": False, "never": True}
    assert _shown(got, "model") == _shown(stale_keys(so_far, wanted, mark), "model")
    # one millisecond on, the timer alone turns it; keys pushed out of the newest rows turn as well
    more = [(10 + i, 1, "local", "mover", edge + timedelta(minutes=30, milliseconds=1)) for i in range(2)]
    so_far, changes, mark = feed(more, owner=())
    assert mark == edge + timedelta(milliseconds=1)
    got = stale_now(changes, wanted)
    assert {r.model: r.stale for r in got.collect()}["edge"]
    so_far, changes, mark = feed([(50 + i, 1, "local", "busy", edge + timedelta(minutes=31)) for i in range(23)], owner=())
    got = stale_now(changes, wanted)
    assert _shown(got, "model") == _shown(stale_keys(so_far, wanted, mark), "model")
    assert {r.model: r.last_used is None for r in got.collect()}["edge"]
    assert changes.groupBy("change").count().filter(F.col("count") > 1).isEmpty()
