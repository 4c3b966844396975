"""From exported commits to digests and reusable earlier answers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators import commits as oc
from daybook.operators import history as oh

RUN = ("author_email", "day")
WINDOW = ("author_email",)


def author_days(
    commits: DataFrame,
    files: DataFrame,
    now: datetime | str | None = None,
    hours: int | None = None,
    authors=None,
    filter_noise: bool = True,
) -> DataFrame:
    """Digest per author and calendar day.

    With a time window, file rows of other commits are dropped before anything is
    reduced: the window's commits are few, and where they are fewer than the broadcast
    limit the file table is filtered while it is read.  Without one, nearly all file
    rows are wanted and go straight into their reduction.

    Exchanges: the cap ships at most its limit per task, author, day and repository;
    file facts are reduced per commit before they move; after the two meet, one
    exchange on (author, day) serves the noise rule and the digest.
    """
    return _digests(commits, files, now, hours, authors, filter_noise, RUN)


def author_windows(
    commits: DataFrame,
    files: DataFrame,
    now: datetime | str,
    hours: int,
    authors=None,
    filter_noise: bool = True,
) -> DataFrame:
    """One digest per author over the whole window, as a single run gives.

    The cap per repository counts over the window, and midnight does not divide it.
    """
    return _digests(commits, files, now, hours, authors, filter_noise, WINDOW)


def _digests(commits, files, now, hours, authors, filter_noise, run) -> DataFrame:
    kept = commits
    if now is not None and hours is not None:
        kept = oc.by_author(oc.lookback(kept, now, hours), authors)
        files = files.join(kept.select("seq"), "seq", "left_semi")
    else:
        kept = oc.by_author(kept, authors)
    if "day" in run:
        kept = kept.withColumn("day", F.to_date("committed_at"))
    kept = oc.cap_newest(kept, [*run, "repo"]).drop("truncated")
    kept = oc.with_subject(kept).withColumn("hash", F.left("hash", F.lit(7)))
    full = oc.with_file_totals(kept, files)
    if filter_noise:
        full = oc.drop_noise_in_capped_runs(full, run)
    return oc.digest(oc.with_lines(oc.annotate(full)), run)


def with_reuse(
    digests: DataFrame,
    history: DataFrame,
    tone: str,
    provider: str,
    requested_at: datetime | str | None = None,
) -> DataFrame:
    """Digests with the newest earlier answer of the same commits, tone and provider.

    An answer counts if it was made on the day of the request; without a request time, each digest's
    own day stands for it.
    """
    wanted = digests.withColumns(
        {
            "commit_hash": F.col("fingerprint"),
            "tone": F.lit(tone),
            "provider": F.lit(provider),
            "requested_at": F.col("day")
            if requested_at is None
            else F.lit(str(requested_at)).cast("timestamp_ntz"),
        }
    )
    return oh.find_reusable(wanted, history).drop("requested_at", "commit_hash")
