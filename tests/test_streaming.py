"""Each stream gives what its batch form gives on the same rows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.functions.text import redact_counted
from daybook.operators import logs, usage
from daybook.operators.admission import admit
from daybook.streaming import flows
from daybook.streaming.admission import AdmissionLimits, admit_stream, use_state_store

START = datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """Write rows as files in the given order, stream them one file per trigger, collect."""

    use_state_store(spark)

    def go(rows, schema, transform, mode="append", files=3, name=None):
        source = str(tmp_path / "in")
        step = max(1, len(rows) // files)
        for i in range(0, len(rows), step):
            part = spark.createDataFrame(rows[i : i + step], schema).coalesce(1)
            part.write.mode("append").parquet(source)
        stream = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        )
        table = name or f"out_{random.randrange(10**9)}"
        query = (
            transform(stream)
            .writeStream.outputMode(mode)
            .format("memory")
            .queryName(table)
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.table(table), spark.read.schema(schema).parquet(source)

    return go


def test_redacted_texts(run):
    rows = [(i, f"token=abc{i} at 10.0.0.{i}") for i in range(9)]
    got, batch = run(rows, "id int, text string", flows.redact_texts)
    want = batch.withColumn("r", redact_counted("text")).select("id", "r.text", "r.hits")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.hits for r in got.collect()} == {2}


def test_redacted_log_lines(run):
    rows = [(i, '{"api_key": "x", "meta": {"token": "t", "n": %d}}' % i if i % 2 else "no json") for i in range(8)]
    got, batch = run(rows, "seq int, line string", flows.redact_log_lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.redact(batch).collect()))
    assert got.count() == 4


def test_daily_usage(run):
    rows = [(i % 3, START + timedelta(hours=5 * i)) for i in range(30)]
    got, batch = run(rows, "user_id bigint, ts timestamp", flows.daily_usage, mode="update")
    # update mode repeats a day as it grows: the last row of a day counts
    final = got.groupBy("user_id", "day").agg(F.max("calls").alias("calls"), F.max("last_call").alias("last_call"))
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, usage.daily(batch).collect()))


def test_days_leave_the_state_once_final(run):
    rows = [(1, START + timedelta(hours=6 * i)) for i in range(40)]
    got, batch = run(rows, "user_id bigint, ts timestamp", flows.daily_usage)
    closed = {r.day: r.calls for r in got.collect()}
    want = {r.day: r.calls for r in usage.daily(batch).collect()}
    assert len(closed) >= 5 and all(want[d] == n for d, n in closed.items())


def test_first_requests(run):
    rows = [(i, f"h{i % 4}", "casual", "local", START + timedelta(hours=i)) for i in range(36)]
    schema = "id int, commit_hash string, tone string, provider string, requested_at timestamp"
    got, batch = run(rows, schema, flows.first_requests)
    keys = [F.col("commit_hash"), F.to_date("requested_at").alias("day")]
    want = batch.select(*keys).distinct()
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("files", [2, 7])
def test_admission_in_any_order_of_arrival(run, files):
    """Shuffled within an hour, with flags and calls without a time, at two trigger sizes."""
    rnd = random.Random(5)
    rows = [
        (
            rnd.randrange(4),
            i,
            START + timedelta(minutes=7 * i),
            rnd.random() < 0.1,
            rnd.random() < 0.1,
            rnd.random() < 0.8,
            START + timedelta(minutes=7 * i + rnd.randrange(30)),
        )
        for i in range(240)
    ]
    rows = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rnd.randrange(60)))
    rows += [(1, 900, None, False, False, True, None), (None, 901, START, False, False, True, None)]
    # far later calls of another user move the watermark past all others
    rows += [(9, 1000 + i, START + timedelta(days=9 + i), False, False, True, None) for i in range(3)]
    schema = "user_id bigint, call_id bigint, ts timestamp, forced boolean, off boolean, ok boolean, done timestamp"
    flags = dict(forced="forced", enabled="on", succeeded="ok", completed="done")
    on = F.expr("NOT off")
    got, batch = run(
        rows,
        schema,
        lambda s: admit_stream(s.withColumn("on", on), 45, 5, lateness="3 hours", **flags),
        files=files,
    )
    want = admit(batch.withColumn("on", on), 45, 5, **flags).filter("coalesce(user_id, 0) <> 9")
    columns = ["user_id", "call_id", "admitted", "reason", "seconds_remaining"]
    shown = sorted(map(tuple, got.filter("coalesce(user_id, 0) <> 9").select(*columns).collect()), key=str)
    assert shown == sorted(map(tuple, want.select(*columns).collect()), key=str)


def test_a_backlog_of_one_user_is_decided_slice_by_slice(run, spark):
    """A user with most rows in the first trigger, in Arrow batches far smaller than the backlog."""
    rnd = random.Random(8)
    rows = [(1 if rnd.random() < 0.7 else rnd.randrange(2, 9), i, START + timedelta(seconds=40 * i)) for i in range(3000)]
    rnd.shuffle(rows)
    rows += [(99, 5000 + i, START + timedelta(days=20 + i)) for i in range(2)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got, batch = run(
            rows,
            "user_id bigint, call_id bigint, ts timestamp",
            lambda s: admit_stream(s, 20, 6, lateness="2 days", slice_minutes=60),
            files=1,
        )
        shown = got.filter("user_id <> 99").drop("at")
        want = admit(batch, 20, 6).filter("user_id <> 99").drop("ts")
        assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, want.collect()))
        assert shown.count() == 3000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_only_one_slice_is_read_at_a_time():
    """The processor against a small stand-in of its state: no call reads more chunks than one slice has."""
    processor = AdmissionLimits(60_000_000, 3, 600_000_000)
    processor.init(Held())
    batches = [
        pd.DataFrame({"at": [m * 60_000_000 for m in minutes], "id": minutes, "done": [m * 60_000_000 for m in minutes], "free": False, "ok": True})
        for minutes in ([0, 25, 3], [12, 4, 31], [26])
    ]
    assert list(processor.handleInputRows(("u",), iter(batches), None)) == []
    assert sorted(processor.handle.timers) == [600_000, 1_200_000, 1_800_000, 2_400_000]
    reads = processor.waiting.reads = []
    decided = processor.handleExpiredTimer(("u",), Mark(1_800_000), None)
    for minutes, chunks in (([0, 3, 4], 2), ([12], 1), ([25, 26], 2)):
        assert next(decided)["id"].tolist() == minutes
        assert len(reads) == chunks
        reads.clear()
    assert list(decided) == []
    assert [k for k in processor.waiting.rows] == [(3, 0)]  # the slice that the watermark has not passed
    list(processor.handleExpiredTimer(("u",), Mark(3 * 86_400_000), None))
    assert not any(s.rows for s in (processor.waiting, processor.chunks, processor.days, processor.last))


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


class Held:
    """State handle kept in memory."""

    def __init__(self):
        self.timers = []
        self.registerTimer = self.timers.append

    def getMapState(self, *_):
        return Rows()

    def getValueState(self, *_):
        return Rows()


class Rows:
    def __init__(self):
        self.rows, self.reads = {}, []

    def getValue(self, key):
        if key in self.rows:
            self.reads.append(key)
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key, None)

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value

    def clear(self):
        self.rows.clear()


def test_short_lateness_of_first_requests_is_refused(spark):
    rows = spark.createDataFrame([], "commit_hash string, tone string, provider string, requested_at timestamp")
    with pytest.raises(ValueError, match="at least 1 day"):
        flows.first_requests(rows, lateness="6 hours")
