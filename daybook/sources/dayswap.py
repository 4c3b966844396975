"""Replacing and dropping day folders of a partitioned table, all of them or none.

New versions of touched days are written beside the table's own folders, in one whose name Spark's
readers skip.  A run that ends before the commit leaves the table as it was, apart from that folder.
The commit is the rename of that folder; from then on the change is decided, and what is left to do
are deletes and renames that can be repeated: ``recover`` ends a change that was cut off half-way,
and removes what uncommitted ones left.  Days that are not touched are neither read nor moved.

Needs a file system whose folder renames are atomic.  One upkeep runs at a time; rows that were
appended to a touched day meanwhile make the commit fail, and the table stays as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "created_date"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
PENDING, COMMITTED = "_pending-", "_committed-"


class Swapped(NamedTuple):
    rewritten: list[str]
    dropped: list[str]


class ChangedMeanwhile(RuntimeError):
    """A touched day got other files while its new version was written."""


class _Files:
    """The few calls on the table's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        if not self.system.exists(where):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(where))

    def remove(self, folder: str) -> None:
        self.system.delete(self.path(folder), True)

    def make(self, folder: str) -> None:
        self.system.mkdirs(self.path(folder))

    def rename(self, folder: str, to: str) -> None:
        if not self.system.rename(self.path(folder), self.path(to)):
            raise OSError(f"cannot rename {folder} to {to}")


def _folder(day: str) -> str:
    return f"{DAY}={day}"


def day_folders(spark: SparkSession, path: str) -> list[str]:
    """The table's days, from its folder names alone."""
    names = _Files(spark, path).names(path)
    return [n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}=")]


def in_days(days: Iterable[str]) -> Column:
    """Condition on the partition column that reads these day folders only."""
    days = list(days)
    known = F.col(DAY).isin([date.fromisoformat(d) for d in days if d != NO_DAY])
    return known | F.col(DAY).isNull() if NO_DAY in days else known


class DaySwap:
    """One change of a table's days: ``touch`` what it reads, ``write`` what stays, then ``commit``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.files = _Files(spark, path)
        self.name = uuid.uuid4().hex
        self.staged = f"{self.root}/{PENDING}{self.name}"
        self.seen: dict[str, list[str]] = {}

    def touch(self, days: Iterable[str]) -> list[str]:
        """Remember the days' files as they are now."""
        for day in days:
            self.seen[day] = self.files.names(f"{self.root}/{_folder(day)}")
        return list(self.seen)

    def touch_days_of(self, rows: DataFrame) -> list[str]:
        """Touch the days that ``rows`` have.

        They are found by writing one small file for each, so however they are computed, only folder names come back.
        """
        found = f"{self.staged}/found"
        rows.groupBy(DAY).count().write.partitionBy(DAY).parquet(found)
        return self.touch([n.removeprefix(f"{DAY}=") for n in self.files.names(found) if n.startswith(f"{DAY}=")])

    def write(self, kept: DataFrame) -> None:
        """Write the rows that stay in the touched days; days without one are dropped at the commit."""
        kept.hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{self.staged}/days")

    def commit(self) -> Swapped:
        if not self.seen:
            self.abandon()
            return Swapped([], [])
        written = [n for n in self.files.names(f"{self.staged}/days") if n.startswith(f"{DAY}=")]
        stray = {n.removeprefix(f"{DAY}=") for n in written} - set(self.seen)
        if stray:
            raise ValueError(f"rows of days that were not touched: {sorted(stray)}")
        dropped = [d for d in self.seen if _folder(d) not in written]
        self.files.make(f"{self.staged}/dropped")
        for day in dropped:
            self.files.make(f"{self.staged}/dropped/{_folder(day)}")
        for day, before in self.seen.items():
            if self.files.names(f"{self.root}/{_folder(day)}") != before:
                raise ChangedMeanwhile(f"{DAY} {day} of {self.root} has other files than were read")
        decided = f"{self.root}/{COMMITTED}{self.name}"
        self.files.rename(self.staged, decided)
        _finish(self.files, self.root, decided)
        return Swapped([n.removeprefix(f"{DAY}=") for n in written], sorted(dropped))

    def abandon(self) -> None:
        self.files.remove(self.staged)


def _finish(files: _Files, root: str, decided: str) -> None:
    """Bring a committed change to its end; each step can be repeated."""
    for name in files.names(f"{decided}/dropped"):
        files.remove(f"{root}/{name}")
    for name in files.names(f"{decided}/days"):
        if name.startswith(f"{DAY}="):
            files.remove(f"{root}/{name}")
            files.rename(f"{decided}/days/{name}", f"{root}/{name}")
    files.remove(decided)


def recover(spark: SparkSession, path: str) -> None:
    """End committed changes that were cut off, and remove uncommitted ones."""
    root = path.rstrip("/")
    files = _Files(spark, path)
    for name in files.names(root):
        if name.startswith(COMMITTED):
            _finish(files, root, f"{root}/{name}")
        elif name.startswith(PENDING):
            files.remove(f"{root}/{name}")
