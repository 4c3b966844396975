"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python, so that a run of very long texts stays small.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the setting is absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder, which is removed when Spark ends.

    Unlike a checkpoint, the table brings its true size to the planner, so plans in loops do not
    multiply the sizes of the rounds before.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: str, parts: int):
    """crc32 of an id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def whole_ids(texts):
    """Ids that came as text, so that nulls beside them do not turn large ones into floats."""
    import pandas as pd

    return pd.array([None if x is None else int(x) for x in texts], "Int64")


@lru_cache(maxsize=1)
def latin_classes() -> dict[str, str]:
    """Letters, numbers and white space below U+0100 as the bodies of character classes."""
    chars = [chr(i) for i in range(256)]

    def of(kind: str) -> str:
        return re.escape("".join(c for c in chars if unicodedata.category(c).startswith(kind)))

    return {"L": of("L"), "N": of("N"), "S": "\t-\r \x85\xa0"}


def bounded_ids(rows: DataFrame, stratum: str, each: int) -> DataFrame:
    """At most ``each`` rows of every stratum, chosen by a hash of ``doc_id``.

    ``rows`` has ``doc_id`` and the stratum only.  The rank is limited in every task before the
    shuffle, so a hot stratum does not gather in one task.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(stratum).orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = rows.where(F.col("doc_id").isNotNull()).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= each).drop("_rank").distinct()
