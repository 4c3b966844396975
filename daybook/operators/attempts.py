"""Scored attempts: choosing the answer that is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions.scores import score_payload


def with_scores(attempts: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``score``, ``issues`` and ``strengths`` read from the raw scoring answer."""
    return attempts.withColumn("_payload", score_payload(raw)).select(
        *attempts.columns, "_payload.*"
    )


def choose(
    attempts: DataFrame,
    min_score: int,
    run: Sequence[str] = ("run_id",),
    max_attempts: int = rules.MAX_ATTEMPTS,
) -> DataFrame:
    """First attempt that reaches ``min_score``, else the last one allowed.

    Both candidates are order statistics of one aggregate, so a run's attempts are
    reduced before the shuffle.
    """
    kept = F.struct("attempt", "response", "score", "issues", "strengths")
    good = F.when(F.col("score") >= int(min_score), F.col("attempt"))
    chosen = (
        attempts.filter(F.col("attempt") <= max_attempts)
        .groupBy(*run)
        .agg(F.coalesce(F.min_by(kept, good), F.max_by(kept, "attempt")).alias("_kept"))
    )
    return chosen.select(*run, "_kept.*", (F.col("_kept.attempt") - 1).alias("retries"))
