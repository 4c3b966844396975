"""JSON-lines logs as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with a ``seq`` that follows file time, file name and place in the file.

    A struct is enough of an order for ``tail``; numbering all lines would need a sort
    of the whole log.
    """
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        F.struct(
            meta["file_modification_time"].alias("file_time"),
            meta["file_name"].alias("file_name"),
            meta["file_block_start"].alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
        F.col("value").alias("line"),
    )


def write_lines(encoded: DataFrame, path: str, ts: str = "ts") -> None:
    """Append encoded lines as text, one folder per day."""
    encoded.select(F.to_date(ts).alias("event_date"), F.col("line").alias("value")).write.mode(
        "append"
    ).partitionBy("event_date").text(path)
