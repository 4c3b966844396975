"""Session settings the operators were planned for."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot keys: let a join split an oversized partition even if that costs an exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "daybook", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` adds to them or overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary folder is set only where Spark runs in one process, as in tests; on a cluster the setting
    must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="daybook-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df):
    """Cut lineage with a table written to the shared folder.

    The table is removed when Spark ends.  It brings its true size to the planner, where a
    checkpoint would carry the estimates of all rounds before it through a loop.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/daybook-{uuid.uuid4().hex}"
    df.write.parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, where it is not installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_daybook_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="daybook-package-")) / "daybook.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted((root / "daybook").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    sc.addPyFile(str(place))
    sc._daybook_shipped = True
