"""Score payloads written by a scoring model, and score bands."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions.text import col

PAYLOAD = T.StructType(
    [
        T.StructField("score", T.IntegerType(), False),
        T.StructField("issues", T.ArrayType(T.StringType(), False), False),
        T.StructField("strengths", T.ArrayType(T.StringType(), False), False),
    ]
)


def _whole(value) -> int:
    """A number, or a text that reads as a whole number, held to 0..100; 0 for anything else."""
    if isinstance(value, str):
        digits = value.strip()
        value = int(digits) if len(digits) < 1000 and re.fullmatch(r"[+-]?\d+(?:_\d+)*", digits) else 0
    elif isinstance(value, float):
        value = 0 if math.isnan(value) else math.trunc(value)
    return min(100, max(0, int(value))) if isinstance(value, int) else 0


def _named_texts(found: dict, name: str) -> list[str]:
    listed = found.get(name)
    shown = map(str, listed if isinstance(listed, list) else ())
    return list(filter(str.strip, shown))


@F.pandas_udf(PAYLOAD)
def _strict_payload(blocks: pd.Series) -> pd.DataFrame:
    """What the strict reader makes of each block; nothing for what is no object."""
    rows = []
    for block in blocks:
        row = (0, [], [])
        try:
            found = json.loads(block) if block else None
            if isinstance(found, dict):
                row = (_whole(found.get("score", 0)), *(_named_texts(found, n) for n in ("issues", "strengths")))
        except (ValueError, OverflowError, RecursionError):
            pass  # not readable: the empty payload
        rows.append(row)
    return pd.DataFrame(rows, columns=["score", "issues", "strengths"])


def score_payload(raw: Column | str) -> Column:
    """Score 0..100, issues and strengths from the widest ``{...}`` of a raw answer.

    The block goes to the strict reader: Spark's readers take texts it refuses and refuse some it
    takes, and reading ordinary blocks by expressions measured slower.
    """
    return _strict_payload(F.regexp_extract(F.coalesce(col(raw), F.lit("")), r"(?s)\{.*\}", 0))


def score_band(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 80, "HIGH").when(s >= 60, "OK").otherwise("LOW")
