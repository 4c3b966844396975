"""What becomes of each request for a text: reused, limited, generated or failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook import rules
from daybook.operators import attempts as oa
from daybook.operators import history as oh
from daybook.operators.admission import admit
from daybook.session import checkpointed
from daybook.sources.tables import append_calls, append_history, read_calls, read_history


def outcomes(
    requests: DataFrame,
    history: DataFrame,
    attempts: DataFrame,
    min_score: int,
    cooldown_minutes: int = rules.DEFAULT_COOLDOWN_MINUTES,
    max_calls: int = rules.DEFAULT_CALLS_PER_DAY,
) -> DataFrame:
    """Each request with its ``outcome``, ``reason``, ``text`` and ``score``.

    A hit takes the stored text and spends no limit: only misses are put to admission.  An admitted
    miss takes the chosen one of its attempts; without attempts it has failed, which is known before
    and so spends no limit either.  ``requests`` holds ``request_id``, ``user_id``, ``requested_at`` and
    the reuse keys; ``attempts`` holds scored attempts by ``request_id``.
    """
    looked = oh.find_reusable(requests, history)
    chosen = oa.choose(attempts, min_score, run=("request_id",)).select(
        "request_id", F.col("response").alias("_made"), F.col("score").alias("_made_score")
    )
    missed = looked.filter(~F.col("hit")).join(chosen, "request_id", "left")
    judged = admit(
        missed.withColumn("_ok", F.col("_made").isNotNull()),
        cooldown_minutes,
        max_calls,
        ts="requested_at",
        order="request_id",
        succeeded="_ok",
    ).select("request_id", "admitted", F.col("reason").alias("_reason"))
    full = looked.join(judged, "request_id", "left").join(chosen, "request_id", "left")
    limited = ~F.coalesce("admitted", F.lit(False))
    return full.select(
        "request_id",
        "user_id",
        F.when(F.col("hit"), "reused")
        .when(limited, "limited")
        .when(F.col("_made").isNull(), "failed")
        .otherwise("generated")
        .alias("outcome"),
        F.coalesce("_reason", F.lit("")).alias("reason"),
        F.when(F.col("hit"), F.col("reused_text")).when(~limited, F.col("_made")).alias("text"),
        F.when(F.col("hit"), F.col("reused_score")).when(~limited, F.col("_made_score")).alias("score"),
    )


def record_outcomes(decided: DataFrame, requests: DataFrame, history_path: str, calls_path: str) -> None:
    """Store generated texts as history rows and as calls that count towards their users' limits.

    Both are kept under the request's id and only where the table has no such row on that day yet, so a
    run that was cut off between the two, or repeated, is finished by running it again: every
    generated text ends up with one history row and one call.  ``requests`` holds what a history row
    has besides text and score: the reuse keys, ``requested_at``, ``model``, ``repos`` and ``hours_lookback``.
    """
    facts = requests.drop("user_id") if "user_id" in requests.columns else requests
    made = checkpointed(
        decided.filter(F.col("outcome") == "generated").join(facts, "request_id").withColumn("day", F.to_date("requested_at"))
    )
    if made.isEmpty():
        return
    spark = decided.sparkSession
    first, last = made.agg(F.min("day"), F.max("day")).first()
    within = F.col("created_date").between(F.lit(first), F.lit(last))
    calls = made.select(F.col("request_id").alias("call_id"), "user_id", F.col("requested_at").alias("ts"))
    known = read_calls(spark, calls_path).select("call_id")
    append_calls(calls.join(known, "call_id", "left_anti"), calls_path)
    rows = made.select(
        F.col("request_id").alias("id"),
        F.col("requested_at").alias("created_at"),
        "commit_hash",
        "provider",
        "model",
        "tone",
        F.col("text").alias("standup_text"),
        "repos",
        "hours_lookback",
        F.col("score").alias("quality_score"),
    )
    stored = read_history(spark, history_path).filter(within).select("id")
    append_history(rows.join(stored, "id", "left_anti"), history_path)
