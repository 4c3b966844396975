"""Settings documents are judged once and written apart, in a batch and in a stream."""

import json

import pytest
from test_answers import GOOD

from daybook.operators import settings
from daybook.sources.routed import read_routed, stream_routed, write_routed

DOCUMENTS = [(1, json.dumps(GOOD)), (2, "no json"), (3, '{"history_hours": "x"}'), (4, "[]"), (5, None), (6, json.dumps(GOOD))]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame(DOCUMENTS, "scope int, settings string").repartition(2).write.parquet(path)
    return path


def _split(spark, path):
    return [sorted(map(str, read_routed(spark, path, valid).collect())) for valid in (True, False)]


def _wanted(judged):
    return [sorted(map(str, part.drop("is_valid").collect())) for part in settings.split_valid(judged)]


def test_one_write_with_its_counts(spark, source, tmp_path):
    judged = settings.validate(spark.read.parquet(source))
    out = str(tmp_path / "out")
    counts = write_routed(judged, out)
    good, bad = _wanted(judged)
    assert counts == {"rows": 6, "invalid": len(bad)} and good and bad
    assert _split(spark, out) == [good, bad]
    write_routed(judged, out)
    assert [len(part) for part in _split(spark, out)] == [2 * len(good), 2 * len(bad)]
    plan = read_routed(spark, out, False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_valid" in plan, plan


def test_stream_equals_batch(spark, source, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # started again, it finds nothing new
        stream = spark.readStream.schema("scope int, settings string").option("maxFilesPerTrigger", 1).parquet(source)
        query = stream_routed(settings.validate(stream), out, checkpoint, availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None
    assert _split(spark, out) == _wanted(settings.validate(spark.read.parquet(source)))


def test_empty_table(spark, source, tmp_path):
    none = spark.read.parquet(source).filter("scope > 100")
    out = str(tmp_path / "out")
    assert write_routed(settings.validate(none), out) == {"rows": 0, "invalid": 0}
