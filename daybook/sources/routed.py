"""Judged rows written once, valid ones and the rest apart, with counts taken during the write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FLAG = "is_valid"


def write_routed(judged: DataFrame, path: str, mode: str = "append") -> dict[str, int]:
    """Write judged rows to one folder for each value of ``is_valid``; the input is read and judged once.

    Returns ``rows`` and ``invalid``, which the write itself counts.
    """
    seen = Observation("routed")
    counted = judged.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col(FLAG)).alias("invalid"))
    counted.write.mode(mode).partitionBy(FLAG).parquet(path)
    return seen.get


def stream_routed(judged: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The same for a stream; the file sink's log makes a repeated trigger write nothing twice."""
    writer = judged.writeStream.format("parquet").partitionBy(FLAG)
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_routed(spark: SparkSession, path: str, valid: bool) -> DataFrame:
    """The valid rows, or those in quarantine with their ``errors``; only their own folder is read."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col(FLAG).cast("string") == str(valid).lower()).drop(FLAG)
