"""Time arguments as literals of the column they are compared with."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(now: datetime | str) -> datetime:
    return now if isinstance(now, datetime) else datetime.fromisoformat(now)


def literal_for(df: DataFrame, column: str, when: datetime) -> Column:
    """A constant of the column's own type, so the comparison reaches the file scan."""
    text = when.isoformat(sep=" ")
    return F.lit(text).cast(df.schema[column].dataType)


def before(now: datetime | str, **span: int) -> datetime:
    return moment(now) - timedelta(**span)
