"""Commit, file and call exports, and the partitioned history table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook import schemas
from daybook.functions.text import storage_clean

FORMATS = ("parquet", "orc", "json", "csv", "avro")


def read_export(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Exported rows under a declared schema: no inference pass, absent columns read null."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got: {fmt!r}")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_export(spark, path, schemas.COMMIT, fmt)


def read_commit_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_export(spark, path, schemas.COMMIT_FILE, fmt)


def read_calls(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Call facts; a missing table is an empty one, like a missing usage file."""
    try:
        return read_export(spark, path, schemas.CALL, fmt)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.CALL)


def append_calls(rows: DataFrame, path: str) -> None:
    """Append call facts."""
    rows.select("call_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).write.mode("append").parquet(path)


def union_repos(tables: Sequence[DataFrame]) -> DataFrame:
    """All repositories' commits as one table; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def append_history(rows: DataFrame, path: str) -> None:
    """Append generated texts, cleaned for storage, under one folder per day.

    Needs ``id``, ``created_at``, ``commit_hash``, ``provider``, ``model``, ``tone``,
    ``standup_text``, ``repos`` (array), ``hours_lookback`` and ``quality_score``.
    """
    stored = rows.withColumns(
        {
            "created_at": F.date_trunc("second", "created_at").cast("timestamp_ntz"),
            "standup_text": storage_clean("standup_text"),
            "repos": F.to_json(F.transform("repos", lambda r: r.cast("string"))),
            "quality_score": F.coalesce("quality_score", F.lit(0)),
            "created_date": F.to_date("created_at"),
        }
    )
    # adaptive execution sizes the parts: a hot day becomes many files, quiet days few
    stored.hint("rebalance", "created_date").write.mode("append").partitionBy(
        "created_date"
    ).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History rows; files from before the score column read a score of 0.

    A missing table is an empty one.
    """
    schema = schemas.HISTORY + ", created_date DATE"
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return stored.withColumn("quality_score", F.coalesce("quality_score", F.lit(0)))


def rewrite_history(kept: DataFrame, path: str) -> None:
    """Write what a retention step keeps to a fresh folder, to be swapped in by the caller.

    The old folder stays readable and whole until then, whatever happens to the job.
    """
    kept.write.mode("errorifexists").partitionBy("created_date").parquet(path)
