"""History of generated texts: reuse, listing, retention, purge, staleness."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions.text import col
from daybook.operators.joins import apart, same_keys
from daybook.operators.times import before, literal_for

REUSE_KEYS = ("commit_hash", "tone", "provider", "day")


def decode_repos(c: Column | str) -> Column:
    """Repository names of a JSON array text; anything else gives an empty array."""
    text = F.trim(col(c), F.lit(" \t\r\n"))
    shaped = F.when(text.startswith("[") & text.endswith("]"), text)
    items = F.try_parse_json(shaped).try_cast("array<variant>")
    names = F.transform(items, lambda v: v.try_cast("string"))
    return F.coalesce(names, F.array().cast("array<string>"))


def decode(history: DataFrame) -> DataFrame:
    """History rows with ``repos`` as an array and a score of 0 where none was kept."""
    score = F.coalesce("quality_score", F.lit(0)) if "quality_score" in history.columns else F.lit(0)
    return history.withColumns({"repos": decode_repos("repos"), "quality_score": score})


def view(history: DataFrame) -> DataFrame:
    """Printed listing: minute, repositories, provider, one-line preview."""
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm")
    preview = F.left(F.replace(F.col("standup_text"), F.lit("\n"), F.lit(" ")), F.lit(80))
    return history.select(
        "id",
        stamp.alias("date"),
        F.array_join(decode_repos("repos"), ", ").alias("repos"),
        "provider",
        preview.alias("preview"),
    )


def _dated(history: DataFrame) -> DataFrame:
    """History with its day: the partition column where the table has one, so that days are pruned."""
    stored = "created_date" in history.columns
    return history.withColumn("day", F.col("created_date") if stored else F.to_date("created_at"))


def _latest_per_key(history: DataFrame) -> DataFrame:
    """Newest row per reuse key, newest id on a tie.

    A ranked limit: each task keeps one row per key before the shuffle.
    """
    dated = _dated(history)
    newest = Window.partitionBy(*REUSE_KEYS, apart(REUSE_KEYS)).orderBy(
        F.col("created_at").desc(), F.col("id").desc()
    )
    return dated.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def find_reusable(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Each request with the newest history row of the same key and day, if any.

    ``requests`` holds ``commit_hash``, ``tone``, ``provider`` and ``requested_at``.
    """
    wanted = requests.withColumn("day", F.to_date("requested_at"))
    found = _latest_per_key(history).select(
        *REUSE_KEYS,
        F.col("id").alias("history_id"),
        F.col("created_at").alias("reused_from"),
        F.col("standup_text").alias("reused_text"),
        F.col("quality_score").alias("reused_score"),
    )
    joined = wanted.join(found, list(REUSE_KEYS), "left")
    return joined.withColumn("hit", F.col("history_id").isNotNull())


def find_missing(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests nothing can be reused for: the only ones to generate, limit and record."""
    wanted = requests.withColumn("day", F.to_date("requested_at"))
    dated = _dated(history)
    known = dated.select(*REUSE_KEYS, apart(REUSE_KEYS)).distinct().select(*REUSE_KEYS)
    return wanted.join(known, list(REUSE_KEYS), "left_anti")


def newest(history: DataFrame, limit: int = 10) -> DataFrame:
    """Newest rows first; the limit is held to 1..100."""
    n = max(1, min(int(limit), rules.MAX_HISTORY_LISTING))
    return history.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def _newest_ranked(history: DataFrame, owner: Sequence[Column | str]) -> DataFrame:
    order = Window.partitionBy(*owner).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return history.withColumn("_rank", F.row_number().over(order))


def keep_newest(
    history: DataFrame, owner: Sequence[str], ceiling: int = rules.MAX_HISTORY_ROWS
) -> DataFrame:
    """Newest ``ceiling`` rows per owner (each task sends at most that many on)."""
    return _newest_ranked(history, owner).filter(F.col("_rank") <= ceiling).drop("_rank")


def ceiling_edges(
    history: DataFrame, owner: Sequence[str], ceiling: int = rules.MAX_HISTORY_ROWS
) -> DataFrame:
    """The last row that retention keeps of each owner with that many rows.

    It comes from the ranked limit, so an owner's full history is never sorted.
    """
    return (
        _newest_ranked(history.select(*owner, "created_at", "id"), [*owner, apart(owner)])
        .filter(F.col("_rank") == ceiling)
        .select(*owner, F.struct("created_at", "id").alias("_edge"))
    )


def by_edges(history: DataFrame, edges: DataFrame, owner: Sequence[str], beyond: bool) -> DataFrame:
    """Rows older than their owner's edge, or all others."""
    older = F.struct("created_at", "id") < F.col("_edge")
    last, same = same_keys(history, edges, owner)
    joined = history.join(last, same, "inner" if beyond else "left")
    return joined.filter(older if beyond else ~F.coalesce(older, F.lit(False))).select(*[history[c] for c in history.columns])


def beyond_ceiling(
    history: DataFrame, owner: Sequence[str], ceiling: int = rules.MAX_HISTORY_ROWS
) -> DataFrame:
    """Rows retention deletes: older than the owner's last kept row."""
    return by_edges(history, ceiling_edges(history, owner, ceiling), owner, beyond=True)


def deleted_counts(
    history: DataFrame, owner: Sequence[str], ceiling: int = rules.MAX_HISTORY_ROWS
) -> DataFrame:
    """Rows retention deletes per owner, null within the ceiling."""
    n = F.count("*")
    return history.groupBy(*owner).agg(F.when(n > ceiling, n - ceiling).alias("deleted"))


def purge(history: DataFrame, now: datetime | str, days: int | None = None) -> DataFrame:
    """Rows left after deleting everything, or everything older than ``days``."""
    if days is None:
        return history.filter(F.lit(False))
    edge = before(now, days=days)
    kept = history.filter(F.col("created_at") >= literal_for(history, "created_at", edge))
    if "created_date" in history.columns:
        kept = kept.filter(F.col("created_date") >= F.lit(edge.date()))
    return kept


def stale_keys(
    history: DataFrame,
    wanted: DataFrame,
    now: datetime | str,
    owner: Sequence[str] = (),
    keys: Sequence[str] = ("provider", "model"),
) -> DataFrame:
    """Wanted keys whose newest use among the owner's 25 newest rows is over an hour old.

    Keys without a use, or with one that has no time, are stale as well.
    """
    ranked = _newest_ranked(history, owner).filter(F.col("_rank") <= rules.STALE_LOOKBACK_ROWS)
    names = [*owner, *keys]
    last = ranked.groupBy(*names, apart(names)).agg(F.max("created_at").alias("last_used"))
    last = last.drop("_apart")
    edge = literal_for(history, "created_at", before(now, minutes=rules.STALE_AFTER_MINUTES))
    stale = F.coalesce(F.col("last_used") < edge, F.lit(True))
    return wanted.join(last, names, "left").withColumn("stale", stale)


def count_rows(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("n"))


def highest_version(versions: DataFrame, column: str = "version") -> DataFrame:
    """Highest recorded version, 0 for an empty table."""
    return versions.agg(F.coalesce(F.max(column), F.lit(0)).alias("version"))


def match_tagged_names(installed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs where the installed name equals the wanted one or adds a ``:tag`` to it.

    Each name is spread into itself and its parts before a colon, which turns the
    prefix test into an equality join.
    """
    parts = F.split("name", ":")
    heads = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":")
    )
    spread = installed.select("name", F.explode(heads).alias("model"))
    return spread.join(wanted.select("model").distinct(), "model").select("model", "name").distinct()
