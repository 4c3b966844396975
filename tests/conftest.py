"""One small local session for all tests."""

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from daybook.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="daybook-checkpoints-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value_of(spark):
    """Value of one column expression over one row."""

    def read(column, **cells):
        schema = ", ".join(f"{n} string" for n in cells) or "x string"
        row = tuple(cells.values()) or ("",)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return read


@pytest.fixture(scope="session")
def values_of(spark):
    """Values of a one-column function over many texts, in order."""

    def read(function, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = df.select("i", function("t").alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]

    return read
