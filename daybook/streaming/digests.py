"""Digests per author and day, kept up to date while commits and file rows arrive.

Each trigger stores its rows, finds the (author, day) groups they touch, computes those groups anew from
all stored rows with the batch plan, and replaces just those digests.  File rows may come before or long
after their commit, in any order, and any row may be delivered again.

Below ``root``:

* ``commits/batch=N/created_date=D`` and ``files/batch=N/block=B``: the rows of trigger N.  A trigger that is
  run again overwrites its own folders, so the store holds every row of it once.
* ``keys/batch=N/block=B``: author and day of every commit, by which late file rows find their group.
* ``digests/created_date=D``: the result.  The days of touched groups are exchanged by ``sources.dayswap``:
  a run that is cut off leaves the earlier digests or is completed by the next trigger.
* ``_checkpoint``: the stream's own.  It lies here since trigger numbers name the stored folders: delete
  both or none.

File rows and keys lie in blocks of ``BLOCK`` consecutive ``seq``; a trigger reads the days and, where the touched
commits are few enough to be broadcast, the blocks it touches.  Work follows the size of the touched groups, not of
the store.  Equal rows count once.  Rows with a null author or day form groups of their own, as in the batch plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from daybook import schemas
from daybook.operators.commits import by_author
from daybook.operators.joins import same_keys
from daybook.plans import daily
from daybook.session import checkpointed
from daybook.sources.dayswap import DAY, DaySwap, in_days, recover

GROUP = ("author_email", DAY)
BLOCK = 1_000_000
KEY = "seq BIGINT, author_email STRING, " + DAY + " DATE"
DIGEST = (
    "author_email STRING, day DATE, commits BIGINT, insertions BIGINT, deletions BIGINT, modules ARRAY<STRING>, "
    "repos ARRAY<STRING>, digest STRING, fingerprint STRING"
)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _block() -> Column:
    return F.floor(F.col("seq") / BLOCK)


def arrivals(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Both streams as one, so that one trigger number covers both; other columns are left behind."""
    commit, file = (F.struct(*_names(s)) for s in (schemas.COMMIT, schemas.COMMIT_FILE))
    return commits.select(commit.alias("commit")).unionByName(files.select(file.alias("file")), allowMissingColumns=True)


class DigestStore:
    """Stored rows and digests below one folder."""

    def __init__(self, root: str, authors=None, filter_noise: bool = True):
        self.root, self.authors, self.filter_noise = root.rstrip("/"), authors, filter_noise

    def _rows(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def commits(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "commits", f"{schemas.COMMIT}, batch BIGINT, {DAY} DATE")

    def files(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "files", f"{schemas.COMMIT_FILE}, batch BIGINT, block BIGINT")

    def keys(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "keys", f"{KEY}, batch BIGINT, block BIGINT")

    def digests(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "digests", f"{DIGEST}, {DAY} DATE")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store one trigger's rows; the same trigger again replaces them."""
        spark = rows.sparkSession
        commits = by_author(rows.filter("commit IS NOT NULL").select("commit.*"), self.authors)
        files = rows.filter("file IS NOT NULL").select("file.*")
        self._write(commits.withColumn(DAY, F.to_date("committed_at")), "commits", batch, DAY)
        stored = self.commits(spark).filter(F.col("batch") == batch)
        self._write(stored.select(*_names(KEY), _block().alias("block")), "keys", batch, "block")
        self._write(files.withColumn("block", _block()), "files", batch, "block")

    def _write(self, rows: DataFrame, name: str, batch: int, by: str) -> None:
        target = f"{self.root}/{name}/batch={batch}"
        rows.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(target)

    def touched(self, spark: SparkSession, batch: int) -> DataFrame:
        """(author, day) of the trigger's commits and of the commits its file rows belong to."""
        keys = self.keys(spark)
        own = keys.filter(F.col("batch") == batch).select(*GROUP)
        changed = self.files(spark).filter(F.col("batch") == batch).select("block", "seq").distinct()
        return own.unionByName(keys.join(changed, ["block", "seq"], "left_semi").select(*GROUP)).distinct()

    def refresh(self, spark: SparkSession, batch: int) -> None:
        """Compute the touched groups from all stored rows and replace their digests."""
        digests = f"{self.root}/digests"
        recover(spark, digests)
        groups = checkpointed(self.touched(spark, batch))
        swap = DaySwap(spark, digests)
        days = swap.touch_days_of(groups)
        if days:
            wanted, same = same_keys(commits := self.commits(spark).filter(in_days(days)), groups, GROUP)
            mine = commits.join(wanted, same, "left_semi").select(*_names(schemas.COMMIT)).distinct()
            mine = checkpointed(mine)
            theirs = mine.select("seq", _block().alias("block"))
            files = self.files(spark).join(theirs, ["block", "seq"], "left_semi").select(*_names(schemas.COMMIT_FILE)).distinct()
            fresh = daily.author_days(mine, files, filter_noise=self.filter_noise).withColumn(DAY, F.col("day"))
            old = self.digests(spark).filter(in_days(days))
            replaced, same = same_keys(old, groups, GROUP)
            swap.write(old.join(replaced, same, "left_anti").unionByName(fresh))
        swap.commit()

    def take(self, rows: DataFrame, batch: int) -> None:
        """One trigger; running it again changes nothing."""
        self.add(rows, batch)
        self.refresh(rows.sparkSession, batch)


def keep_digests(commits: DataFrame, files: DataFrame, root: str, authors=None, filter_noise: bool = True) -> DataStreamWriter:
    """A stream writer that keeps ``root/digests`` equal to ``daily.author_days`` of all rows so far.

    The caller sets the trigger and starts it; ``read_digests`` reads the result.
    """
    store = DigestStore(root, authors, filter_noise)
    writer = arrivals(commits, files).writeStream.option("checkpointLocation", f"{store.root}/_checkpoint")
    return writer.foreachBatch(store.take)


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """The digests as ``daily.author_days`` gives them."""
    return DigestStore(root).digests(spark).drop(DAY)
