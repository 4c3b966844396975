"""Upkeep of the history and usage tables, and checks on them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions.text import key_format_ok, mask_key, size_band, size_text
from daybook.operators import health, history, settings, usage
from daybook.operators.times import before
from daybook.session import checkpointed
from daybook.sources.dayswap import NO_DAY, DaySwap, Swapped, day_folders, in_days, recover
from daybook.sources.tables import read_history


def prune_history(
    spark: SparkSession, path: str, owner: Sequence[str], ceiling: int = rules.MAX_HISTORY_ROWS
) -> Swapped:
    """Delete the rows beyond each owner's ceiling from the history table, in place.

    The owners' edges are found from keys and times of all days.  Only days with a row to delete are
    then read whole and written anew, or dropped where none of their rows stays.
    """
    recover(spark, path)
    change = DaySwap(spark, path)
    rows = read_history(spark, path)
    edges = checkpointed(history.ceiling_edges(rows, owner, ceiling))
    facts = rows.select(*dict.fromkeys([*owner, "created_at", "id", "created_date"]))
    days = change.touch_days_of(history.by_edges(facts, edges, owner, beyond=True))
    if days:
        change.write(history.by_edges(rows.filter(in_days(days)), edges, owner, beyond=False))
    return change.commit()


def purge_history(spark: SparkSession, path: str, now: datetime | str, days: int | None = None) -> Swapped:
    """Delete everything, or everything older than ``days``, from the history table, in place.

    Whole days before the edge are dropped by their folder names, unread, as are rows without a time; the
    day that holds the edge is the only one read.
    """
    recover(spark, path)
    change = DaySwap(spark, path)
    stored = day_folders(spark, path)
    if days is None:
        change.touch(stored)
        return change.commit()
    edge = before(now, days=days)
    cut = edge.date().isoformat()
    change.touch(d for d in stored if d == NO_DAY or d < cut)
    if cut in stored:
        day = read_history(spark, path).filter(in_days([cut]))
        kept = history.purge(day, now, days)
        if day.count() > kept.count():
            change.touch([cut])
            change.write(kept)
    return change.commit()


def summary(
    rows: DataFrame, per_day: DataFrame, now: datetime | str, owner: Sequence[str]
) -> DataFrame:
    """One row per upkeep task with its result and how many rows it removes."""
    deleted = history.deleted_counts(rows, owner).agg(F.sum("deleted").alias("affected"))
    result = F.when(F.col("affected").isNull(), "No cleanup needed").otherwise(
        F.concat(F.col("affected").cast("string"), F.lit(" row(s) deleted"))
    )
    cleanup = deleted.select(
        F.lit("History cleanup").alias("task"),
        result.alias("result"),
        F.coalesce("affected", F.lit(0)).alias("affected"),
    )
    first = usage.first_kept_day(now)
    pruned = per_day.agg(F.count_if(F.col("day") < F.lit(first)).alias("affected")).select(
        F.lit("Usage prune").alias("task"), F.lit("Completed").alias("result"), "affected"
    )
    return cleanup.unionByName(pruned)


def table_health(
    rows: DataFrame,
    versions: DataFrame,
    documents: DataFrame,
    keys: DataFrame,
    latest: int,
    tasks: int | None = None,
) -> DataFrame:
    """Checks of the history, version, settings and key tables, one row each.

    Settings documents are judged in ``tasks`` tasks, see ``settings.validate``.
    """
    n_bytes = F.sum(F.octet_length("standup_text"))
    history_facts = rows.agg(
        F.count("*").alias("n"), F.coalesce(n_bytes, F.lit(0)).alias("n_bytes")
    )
    version = history.highest_version(versions)
    current = F.when(F.col("version") == latest, "pass").otherwise("warn")
    valid = settings.validate(documents, tasks=tasks).agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_valid")).alias("bad")
    )
    formats = keys.agg(
        F.count_if(F.col("key") != "").alias("n"),
        F.count_if((F.col("key") != "") & ~key_format_ok("key")).alias("bad"),
        F.min(F.when(key_format_ok("key"), F.col("key"))).alias("one"),
    )
    key_status = (
        F.when(F.col("n") == 0, "warn").when(F.col("bad") > 0, "fail").otherwise("pass")
    )
    key_detail = (
        F.when(F.col("n") == 0, "No key to validate.")
        .when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" invalid key(s)")))
        .otherwise(F.concat(F.lit("Key looks valid: "), mask_key("one")))
    )
    return health.all_checks(
        [
            health.check(history_facts, "History size", size_band("n_bytes"), size_text("n_bytes")),
            health.check(history_facts, "History rows", F.lit("pass"), F.col("n")),
            health.check(
                version,
                "History schema",
                current,
                F.concat(F.col("version").cast("string"), F.lit(f"/{latest}")),
            ),
            health.check(
                valid,
                "Settings valid",
                F.when(F.col("bad") > 0, "fail").otherwise("pass"),
                F.concat(
                    F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"),
                    F.lit(" invalid"),
                ),
            ),
            health.check(formats, "Key format", key_status, key_detail),
        ]
    )
