"""Commit tables: window, author, cap, noise, types, files, totals and digests.

``run`` means the columns that name one digest run, such as author and day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions import commits as fc
from daybook.functions.text import strip, subject_line
from daybook.operators.joins import apart, same_keys
from daybook.operators.times import before, literal_for


def lookback(
    df: DataFrame, now: datetime | str, hours: int, ts: str = "committed_at"
) -> DataFrame:
    """Rows of the last ``hours``, ``now`` given by the caller."""
    return df.filter(F.col(ts) >= literal_for(df, ts, before(now, hours=hours)))


def lookback_strict_walk(
    df: DataFrame,
    now: datetime | str,
    hours: int,
    ts: str = "committed_at",
    repo: str = "repo",
    seq: str = "seq",
) -> DataFrame:
    """Rows a walk in ``seq`` order meets before its first row older than the window.

    The stopping place per repository is a plain minimum, combined before the
    shuffle, so no repository is ever sorted in one task.
    """
    cutoff = literal_for(df, ts, before(now, hours=hours))
    older = df.filter(F.col(ts) < cutoff).groupBy(repo, apart([repo]))
    stops = older.agg(F.min(seq).alias("_stop")).drop("_apart")
    inside = df.filter(F.col(ts) >= cutoff).join(stops, repo, "left")
    reached = F.col("_stop").isNull() | (F.col(seq) < F.col("_stop"))
    return inside.filter(reached).drop("_stop")


def by_author(
    df: DataFrame, authors: DataFrame | Sequence[str] | str | None, column: str = "author_email"
) -> DataFrame:
    """Rows of the given authors, exact match; no authors keeps every row."""
    if isinstance(authors, DataFrame):
        return df if authors.isEmpty() else df.join(authors.select(column), column, "left_semi")
    names = [authors] if isinstance(authors, str) else list(authors or [])
    names = [n for n in names if n]
    return df.filter(F.col(column).isin(*names)) if names else df


def cap_newest(
    df: DataFrame,
    keys: Sequence[str] = ("repo",),
    limit: int = rules.MAX_COMMITS_PER_REPO,
    ts: str = "committed_at",
    seq: str = "seq",
) -> DataFrame:
    """Newest ``limit`` rows per key and whether the cap was reached.

    Every task drops all but its own newest rows before the shuffle, so a hot
    repository sends at most ``limit`` rows per task.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(seq))
    kept = df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    reached = F.max("_rank").over(Window.partitionBy(*keys)) >= limit
    return kept.withColumn("truncated", reached).drop("_rank")


def with_subject(df: DataFrame, message: str = "message") -> DataFrame:
    return df.withColumn(message, subject_line(message))


def annotate(df: DataFrame, message: str = "message") -> DataFrame:
    """Add type key and emoji; no row is dropped."""
    typed = _with_type(df, message)
    return typed.withColumn("type_emoji", fc.type_attribute("type", 1))


def _with_type(df: DataFrame, message: str, given: str | None = None) -> DataFrame:
    """Add ``type``; a given type stays where it is not empty."""
    kind = fc.classify_trimmed("_trimmed")
    if given:
        kind = F.coalesce(F.nullif(F.col(given), F.lit("")), kind)
    trimmed = df.withColumn("_trimmed", strip(message))
    return trimmed.withColumn("type", kind).drop("_trimmed")


def drop_noise(df: DataFrame, run: Sequence[str], message: str = "message") -> DataFrame:
    """Rows that are no noise; a run with nothing else keeps all its rows.

    Runs are reduced before the shuffle, so a run of any size is fine; a null in a run's key is a
    value like any other.
    """
    flagged = df.withColumn("_noise", fc.is_noise(message))
    runs = flagged.groupBy(*run, apart(run)).agg(F.min("_noise").alias("_all")).drop("_apart")
    only_noise, same = same_keys(flagged, runs.filter("_all"), run)
    joined = flagged.join(only_noise, same, "left")
    kept = joined.filter(~F.col("_noise") | F.coalesce("_all", F.lit(False)))
    return kept.select(*df.columns)


def drop_noise_in_capped_runs(
    df: DataFrame, run: Sequence[str], message: str = "message"
) -> DataFrame:
    """``drop_noise`` for runs already capped: one window on the run, no second read."""
    noise = fc.is_noise(message)
    flagged = df.withColumn("_noise", noise)
    signal = F.max((~F.col("_noise")).cast("int")).over(Window.partitionBy(*run))
    kept = flagged.withColumn("_signal", signal).filter(~F.col("_noise") | (F.col("_signal") == 0))
    return kept.drop("_noise", "_signal")


def count_by_type(df: DataFrame, keys: Sequence[str] = (), message: str = "message") -> DataFrame:
    """Rows per type; a missing or empty type is classified from the message."""
    typed = _with_type(df, message, "type" if "type" in df.columns else None)
    return typed.groupBy(*keys, "type").agg(F.count("*").alias("n"))


# --- files -------------------------------------------------------------------


def _named_files(files: DataFrame) -> DataFrame:
    return files.withColumn("path", fc.changed_path("a_path", "b_path"))


def file_totals(files: DataFrame, key: str = "seq", shown: int = 5) -> DataFrame:
    """Per commit: file count, line counts, modules and the first paths.

    Nothing here grows with a commit's file count: counts and module names are
    combined before the shuffle, and the first paths come from a ranked limit.
    """
    named = _named_files(files)
    totals = named.groupBy(key).agg(
        F.count("path").alias("n_files"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        F.array_sort(F.collect_set(fc.path_module("path"))).alias("modules"),
    )
    order = Window.partitionBy(key).orderBy("pos", "path")
    first = (
        named.filter(F.col("path").isNotNull())
        .select(key, "pos", "path")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= shown)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("_first"))
        .select(key, F.col("_first.path").alias("first_paths"))
    )
    return totals.join(first, key, "left")


def with_file_totals(commits: DataFrame, files: DataFrame, key: str = "seq") -> DataFrame:
    """Commits with their file facts; commits without files read 0 and empty lists."""
    none = F.array().cast("array<string>")
    return commits.join(file_totals(files, key), key, "left").withColumns(
        {
            "n_files": F.coalesce("n_files", F.lit(0)),
            "insertions": F.coalesce("insertions", F.lit(0)),
            "deletions": F.coalesce("deletions", F.lit(0)),
            "modules": F.coalesce("modules", none),
            "first_paths": F.coalesce("first_paths", none),
        }
    )


def paths(files: DataFrame, key: str = "seq") -> DataFrame:
    """One row per named file of a commit: (commit, pos, path)."""
    named = _named_files(files).filter(F.col("path").isNotNull())
    return named.select(key, "pos", "path")


def scan(commits: DataFrame, files: DataFrame, key: str = "seq") -> DataFrame:
    """Commit records: subject, short hash, local minute, file count, line counts, modules.

    One row per commit whatever its size, from one reduction of the file table.  Its files are the
    rows of ``paths``, so no task ever gathers a huge commit.
    """
    facts = (
        _named_files(files)
        .groupBy(key)
        .agg(
            F.count("path").alias("n_files"),
            F.sum("insertions").alias("insertions"),
            F.sum("deletions").alias("deletions"),
            F.array_sort(F.collect_set(fc.path_module("path"))).alias("modules"),
        )
    )
    none = F.array().cast("array<string>")
    return commits.join(facts, key, "left").select(
        key,
        "repo",
        F.left("hash", F.lit(7)).alias("hash"),
        "author_email",
        "committed_at",
        subject_line("message").alias("message"),
        fc.minute_text("committed_at", "tz_offset_min").alias("timestamp"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("insertions", F.lit(0)).alias("insertions"),
        F.coalesce("deletions", F.lit(0)).alias("deletions"),
        F.coalesce("modules", none).alias("modules"),
    )


# --- per run -----------------------------------------------------------------


def totals(df: DataFrame, run: Sequence[str]) -> DataFrame:
    """Commit, insertion and deletion totals and module names of groups of any size.

    Rows are spread over (run, module) and reduced before either shuffle, so a hot
    run is split by its modules instead of meeting in one task.
    """
    spread = df.select(*run, "insertions", "deletions", F.posexplode_outer("modules"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0

    def once(value):
        return F.sum(F.when(first, value).otherwise(0))

    per_module = spread.groupBy(*run, "col").agg(
        once(F.lit(1)).alias("n"),
        once(F.coalesce("insertions", F.lit(0))).alias("ins"),
        once(F.coalesce("deletions", F.lit(0))).alias("del"),
    )
    return per_module.groupBy(*run).agg(
        F.sum("n").alias("commits"),
        F.sum("ins").alias("insertions"),
        F.sum("del").alias("deletions"),
        F.array_sort(F.collect_set("col")).alias("modules"),
    )


def repo_names(df: DataFrame, run: Sequence[str], repo: str = "repo") -> DataFrame:
    """Sorted distinct non-empty repository names per run."""
    named = F.nullif(F.col(repo), F.lit(""))
    return df.groupBy(*run).agg(F.array_sort(F.collect_set(named)).alias("repos"))


def _fingerprint_of(hashes):
    return F.sha2(F.array_join(F.array_sort(hashes), "\n"), 256)


def usable_hash(column: str):
    return F.nullif(strip(column), F.lit(""))


def fingerprint(df: DataFrame, run: Sequence[str], hash_column: str = "hash") -> DataFrame:
    """Order-independent SHA-256 of a run's hashes, repeats kept.

    The list of hashes is one row here, so runs must be capped first (``cap_newest``), which is what
    bounds them in a digest as well; ``folds.fingerprint_any_size`` has no such condition.
    """
    hashes = F.collect_list(usable_hash(hash_column))
    return df.groupBy(*run).agg(_fingerprint_of(hashes).alias("fingerprint"))


def with_lines(df: DataFrame) -> DataFrame:
    """Add the printed digest line of each annotated commit with file totals."""
    return df.withColumn(
        "line",
        fc.commit_line(
            fc.minute_text("committed_at", "tz_offset_min"),
            "type",
            "type_emoji",
            "message",
            fc.files_preview("first_paths", "n_files"),
            "insertions",
            "deletions",
        ),
    )


def digest(df: DataFrame, run: Sequence[str], seq: str = "seq") -> DataFrame:
    """Digest text, totals, names and fingerprint per capped run.

    Repositories come in the order of their first commit, commits in ``seq`` order.
    A run is at most the cap times its repositories; cap first, or take ``folds.digest_parts``.
    """
    line = F.struct(F.col(seq).alias("seq"), "line")
    per_repo = df.groupBy(*run, "repo").agg(
        F.min(seq).alias("_first"),
        F.array_sort(F.collect_list(line)).alias("_lines"),
        F.count("*").alias("_n"),
        F.sum("insertions").alias("_ins"),
        F.sum("deletions").alias("_del"),
        F.array_distinct(F.flatten(F.collect_list("modules"))).alias("_modules"),
        F.collect_list(usable_hash("hash")).alias("_hashes"),
    )
    block = F.concat(
        F.lit("REPO: "), F.coalesce("repo", F.lit("")), F.lit("\n"), F.array_join("_lines.line", "\n"), F.lit("\n")
    )
    per_run = (
        per_repo.withColumn("_block", F.struct("_first", block.alias("text")))
        .groupBy(*run)
        .agg(
            F.array_sort(F.collect_list("_block")).alias("_blocks"),
            F.sum("_n").alias("commits"),
            F.sum("_ins").alias("insertions"),
            F.sum("_del").alias("deletions"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_modules")))).alias("modules"),
            F.array_sort(F.collect_set(F.nullif(F.col("repo"), F.lit("")))).alias("repos"),
            F.flatten(F.collect_list("_hashes")).alias("_hashes"),
        )
    )
    summary = fc.summary_line(
        F.col("commits"), F.col("insertions"), F.col("deletions"), F.col("modules")
    )
    return per_run.select(
        *run,
        "commits",
        "insertions",
        "deletions",
        "modules",
        "repos",
        F.concat_ws("\n", F.array_join("_blocks.text", "\n"), summary).alias("digest"),
        _fingerprint_of(F.col("_hashes")).alias("fingerprint"),
    )
