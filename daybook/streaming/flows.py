"""Streams of texts, log lines, calls and requests.

Every function takes a streaming DataFrame and returns one; the caller picks source,
sink, trigger and checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import redact_counted
from daybook.operators import logs
from daybook.operators.history import REUSE_KEYS


def redact_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Redacted text and hit count per row; no state."""
    out = texts.withColumn("_r", redact_counted(column))
    return out.withColumns({column: F.col("_r.text"), "hits": F.col("_r.hits")}).drop("_r")


def redact_log_lines(lines: DataFrame) -> DataFrame:
    """Log lines with sensitive fields hidden; no state."""
    return logs.redact(lines)


def daily_usage(
    calls: DataFrame, user: str = "user_id", ts: str = "ts", lateness: str = "1 day"
) -> DataFrame:
    """Calls per user and day; a day is final once the watermark has passed it."""
    return (
        calls.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 day").alias("_w"), user)
        .agg(F.count("*").alias("calls"), F.max(ts).alias("last_call"))
        .select(user, F.to_date("_w.start").alias("day"), "calls", "last_call")
    )


def first_requests(
    requests: DataFrame, ts: str = "requested_at", lateness: str = "1 day"
) -> DataFrame:
    """First request per fingerprint, tone, provider and day: the ones to generate for.

    The key holds the day, so state is dropped once the watermark is past it.  A key is remembered for
    ``lateness`` only, so less than a day would let repeats of the same day through and is refused.
    """
    days = requests.sparkSession.sql(f"SELECT INTERVAL {lateness} >= INTERVAL 1 DAY AS enough").first()
    if not days["enough"]:
        raise ValueError(f"lateness must be at least 1 day, got: {lateness!r}")
    dated = requests.withColumn("day", F.to_date(ts)).withWatermark(ts, lateness)
    return dated.dropDuplicatesWithinWatermark(["commit_hash", "tone", "provider", "day"])


def find_reusable(requests: DataFrame, history: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each request with the newest history row of the same key and day, or without one: the batch lookup as a
    join of two streams.

    Columns are those of ``operators.history.find_reusable``.  Both sides carry a watermark and are joined on the
    reuse key and the day's window, so a day's rows leave the state once both watermarks have passed its end;
    then the day's hits and misses come out, each request once.  History rows that come later than ``lateness``
    after the day was closed are not seen.  A request delivered again, equal in every column, is one request.
    Requests without a time have no day: they are misses and come out at once.
    """
    names = requests.columns
    day = F.window("_at", "1 day").alias("_day")
    timed = requests.withColumn("_at", F.col("requested_at").cast("timestamp"))
    asked = timed.filter("_at IS NOT NULL").withWatermark("_at", lateness).select(*names, day)
    made = (
        history.withColumn("_at", F.col("created_at").cast("timestamp"))
        .withWatermark("_at", lateness)
        .select(
            *[F.col(k).alias(f"_{k}") for k in REUSE_KEYS if k != "day"],
            day.alias("_made"),
            F.struct("created_at", "id", "standup_text", "quality_score").alias("_row"),
        )
    )
    same = F.col("_day") == F.col("_made")
    for key in REUSE_KEYS:
        if key != "day":
            same &= F.col(key) == F.col(f"_{key}")
    found = asked.join(made, same, "left").groupBy("_day", *names).agg(F.max("_row").alias("_row"))
    answered = found.withColumn("day", F.to_date("_day.start")).select(*names, "day", "_row")
    row = answered.schema["_row"].dataType
    dateless = timed.filter("_at IS NULL").select(
        *names, F.lit(None).cast("date").alias("day"), F.lit(None).cast(row).alias("_row")
    )
    return answered.unionByName(dateless).select(
        *names,
        "day",
        F.col("_row.id").alias("history_id"),
        F.col("_row.created_at").alias("reused_from"),
        F.col("_row.standup_text").alias("reused_text"),
        F.col("_row.quality_score").alias("reused_score"),
        F.col("_row").isNotNull().alias("hit"),
    )
