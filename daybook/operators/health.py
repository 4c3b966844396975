"""Check tables: one row per check, and the score over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(checks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Health score per scope: passes count full, warnings and notes half, cut to whole."""
    passed = F.count_if(F.col("status") == "pass")
    warned = F.count_if(F.col("status").isin("warn", "info"))
    failed = F.count_if(F.col("status") == "fail")
    total = F.count("*")
    points = F.when(total > 0, F.floor(100 * (passed + 0.5 * warned) / total)).otherwise(0)
    counted = checks.groupBy(*scope).agg(
        points.cast("int").alias("score"),
        passed.alias("passed"),
        warned.alias("warned"),
        failed.alias("failed"),
    )
    return counted.withColumn("band", score_colour("score"))


def score_colour(column: str) -> Column:
    s = F.col(column)
    return F.when(s >= 80, "good").when(s >= 60, "fair").otherwise("low")


def check(df: DataFrame, name: str, status: Column, detail: Column) -> DataFrame:
    """One check row out of a one-row aggregate."""
    return df.select(
        F.lit(name).alias("check"), status.alias("status"), detail.cast("string").alias("detail")
    )


def all_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
