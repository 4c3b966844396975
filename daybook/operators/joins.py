"""Joins of big tables with reduced ones, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(keys: Sequence[str]) -> Column:
    """A further grouping column, fixed by the keys, for tables reduced to be joined.

    Adaptive execution splits a hot key of a join only when both inputs are plain
    exchanges.  A table grouped by exactly the join keys would be joined without an
    exchange of its own and so keep the other side's hot key in one task.  Grouped by
    this column as well, the rows are the same, and the join brings its own exchange;
    where that turns out small, it becomes a broadcast of known size.
    """
    return F.xxhash64(*keys).alias("_apart")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], mark: str = "_r_") -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that the keys are equal, nulls included."""
    renamed = right.withColumnsRenamed({k: mark + k for k in keys})
    return renamed, reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[mark + k]) for k in keys])
