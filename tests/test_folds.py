"""Folds of runs of any size give what the capped forms give, over any batch and part bounds."""

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from daybook.operators import commits as oc
from daybook.operators import folds

NAMES = "seq bigint, repo string, hash string, author_email string, committed_at timestamp_ntz, tz_offset_min int, message string"
FILES = "seq bigint, pos int, a_path string, b_path string, insertions bigint, deletions bigint"


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def _annotated(spark, n=120):
    rnd = random.Random(2)
    rows = [
        (
            i,
            rnd.choice(["a", "b", "", None]),
            rnd.choice([f"{rnd.randrange(40):07d}", " x ", "", None]),
            "hot@x" if rnd.random() < 0.6 else rnd.choice(["b@x", "c@x", None]),
            datetime(2024, 1, 1, rnd.randrange(24)),
            0,
            rnd.choice(["fix: ü one", "feat: two", "wip", "", None]),
        )
        for i in range(n)
    ]
    rows.append((n, "a", None, "lone@x", datetime(2024, 1, 1), 0, "wip"))
    files = [(i, 0, "", f"m{i % 3}/f.py", i, 1) for i in range(0, n, 2)]
    full = oc.with_file_totals(oc.with_subject(spark.createDataFrame(rows, NAMES)), spark.createDataFrame(files, FILES))
    return oc.with_lines(oc.annotate(full))


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fingerprints_equal_those_of_lists(spark, small_batches):
    df = _annotated(spark)
    for run in (["author_email"], ["author_email", "repo"], []):
        assert _sorted(folds.fingerprint_any_size(df, run)) == _sorted(oc.fingerprint(df, run))
    assert folds.fingerprint_any_size(df.limit(0), ["author_email"]).isEmpty()


@pytest.mark.parametrize("part_chars", [1, 60, 500, 1 << 20])
def test_parts_make_up_the_digest(spark, small_batches, part_chars):
    df = _annotated(spark)
    parts = folds.digest_parts(df, ["author_email"], part_chars=part_chars).collect()
    texts = {}
    for row in sorted(parts, key=lambda r: r.part):
        assert row.part == len(texts.setdefault(row.author_email, []))
        texts[row.author_email].append(row.text)
        so_far = "".join(texts[row.author_email])
        assert row.n_chars == len(so_far) and row.sha256 == hashlib.sha256(so_far.encode()).hexdigest()
    want = {r.author_email: r.digest for r in oc.digest(df, ["author_email"]).collect()}
    assert {k: "".join(v) for k, v in texts.items()} == want
    last = {}
    for row in parts:
        last[row.author_email] = max(row.part, last.get(row.author_email, 0))
    assert all(len(r.text) >= part_chars for r in parts if r.part < last[r.author_email])
    assert len(texts["hot@x"]) > 1 or part_chars > 500


def test_no_run_is_gathered_into_one_row(spark):
    columns = "author_email string, repo string, seq bigint, line string, hash string, insertions bigint, deletions bigint, modules array<string>"
    df = spark.createDataFrame([("a@x", "r", 1, "l", "h", 1, 0, ["m"])], columns)
    for folded in (folds.fingerprint_any_size(df, ["author_email"]), folds.digest_parts(df, ["author_email"])):
        plan = folded._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Window" in plan


def test_a_run_far_larger_than_a_batch(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") % 50 == 0).cast("int").alias("run"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    got = {r.run: r.fingerprint for r in folds.fingerprint_any_size(df, ["run"]).collect()}
    for run in (0, 1):
        hashes = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n) if (i % 50 == 0) == bool(run))
        assert got[run] == hashlib.sha256("\n".join(hashes).encode()).hexdigest()
