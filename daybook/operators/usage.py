"""Usage: calls per day, the seven-day report and its pruning."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook import rules
from daybook.operators.times import moment


def daily(calls: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Calls per user and day, and the last call of that day."""
    return calls.groupBy(user, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("calls"), F.max(ts).alias("last_call")
    )


def prune(per_day: DataFrame, now: datetime | str, days: int = rules.USAGE_DAYS_KEPT) -> DataFrame:
    """Days not older than the kept span."""
    return per_day.filter(F.col("day") >= F.lit(first_kept_day(now, days)))


def first_kept_day(now: datetime | str, days: int = rules.USAGE_DAYS_KEPT) -> date:
    return (moment(now) - timedelta(days=days)).date()


def report(
    users: DataFrame,
    calls: DataFrame,
    now: datetime | str,
    user: str = "user_id",
    ts: str = "ts",
    title: str = "Usage Report",
) -> DataFrame:
    """Seven-day report per user: counts per day, bars, totals, last call or ``Never``.

    The seven counts are seven conditional sums of one aggregate; days without calls
    need no calendar to join.
    """
    today = moment(now).date()
    days = [today - timedelta(days=back) for back in range(6, -1, -1)]
    day = F.to_date(ts)
    per_user = calls.groupBy(user).agg(
        *[F.count_if(day == F.lit(d)).alias(f"_d{i}") for i, d in enumerate(days)],
        F.count("*").alias("_all"),
        F.max(ts).alias("_last"),
    )
    known = users.select(user).distinct().join(per_user, user, "left")
    counts = F.array(*[F.coalesce(f"_d{i}", F.lit(0)) for i in range(7)])
    most = F.greatest(F.array_max(counts), F.lit(1))
    steps = len(rules.BARS) - 1

    def bar(n):
        level = F.floor(n / most * steps).cast("int") + 1
        return F.when(n > 0, F.substring(F.lit(rules.BARS), level, F.lit(1))).otherwise(" ")

    facts = known.select(
        user,
        counts.alias("counts"),
        F.array_join(F.transform(counts, bar), "").alias("spark"),
        F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("total_7d"),
        F.coalesce("_all", F.lit(0)).alias("total_all"),
        F.coalesce(F.date_format("_last", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Never")).alias(
            "last_call"
        ),
    )
    rule = "─" * 32
    lines = [
        F.lit(f"📊 {title}"),
        F.lit(rule),
        F.concat(F.lit("Last 7 days: ["), F.col("spark"), F.lit("]")),
        *[
            F.concat(F.lit(f"  {d}: "), F.get("counts", F.lit(i)).cast("string"), F.lit(" call(s)"))
            for i, d in enumerate(days)
        ],
        F.lit(rule),
        F.concat(F.lit("Total (7d): "), F.col("total_7d").cast("string"), F.lit(" calls")),
        F.concat(F.lit("Total (all): "), F.col("total_all").cast("string"), F.lit(" calls")),
        F.concat(F.lit("Last call:   "), F.col("last_call")),
    ]
    return facts.withColumn("report", F.concat_ws("\n", *lines))
