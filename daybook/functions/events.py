"""Structured log lines: one JSON object per line.

Flat lines of texts, truth values, nulls, ordinary integers and plain decimals are read, printed and
redacted by Spark's expressions, whatever their texts hold.  All other lines shaped like an object go to the strict JSON reader, which keeps
what Spark's variant would change or refuse: objects in objects, numbers of any length or form, ``NaN``,
repeated names (the last one counts).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook import rules
from daybook.functions.text import col

FIELDS = "map<string,variant>"
VIEWED = T.StructType(
    [T.StructField("found", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("ts", "event", "detail")]
)
#: After the opening brace: brackets, fractions, exponents, or more digits than a long integer holds.
UNUSUAL = r"[{\[]|[0-9][.][0-9]|[0-9][eE]|[0-9]{19}"
#: A text in quotes, and a decimal that is printed as it was written: few digits, none of them superfluous.
QUOTED = r'"(?:[^"\\]|\\.)*"'
PLAIN_DECIMAL = r"(?<=[:\s])-?(?:0|[1-9][0-9]{0,9})[.][0-9]{0,3}[1-9](?=[\s,}])"
#: Names to hide, whole or by a part of them; the safe names win.
SENSITIVE = f"^(?:{'|'.join(rules.SENSITIVE_LOG_KEYS)})$|{'|'.join(rules.SENSITIVE_LOG_FRAGMENTS)}"


def hides(name: str) -> bool:
    """Whether values under this name are hidden."""
    lowered = name.strip().lower()
    return lowered not in rules.SAFE_LOG_KEYS and re.search(SENSITIVE, lowered) is not None


def hides_column(name: Column) -> Column:
    """``hides`` as an expression."""
    lowered = F.lower(F.trim(name, F.lit(rules.WHITESPACE)))
    return ~lowered.isin(*rules.SAFE_LOG_KEYS) & lowered.rlike(SENSITIVE)


def _shaped(line: Column | str) -> Column:
    """The trimmed line where it begins and ends like an object, else null."""
    text = F.trim(col(line), F.lit(" \t\r\n"))
    return F.when(text.startswith("{") & text.endswith("}"), text)


def flat_fields(line: Column | str) -> Column:
    """Field map of a flat line, names in order; null for any other line."""
    text = _shaped(line)
    inside = F.substring(text, 2, 2**31 - 1)
    bare = F.regexp_replace(F.regexp_replace(inside, QUOTED, '""'), PLAIN_DECIMAL, "0")
    # most lines pass the first test; only the others are looked at without their texts and decimals
    plain = F.when(~inside.rlike(UNUSUAL), text).when(~bare.rlike(UNUSUAL), text)
    return F.try_parse_json(plain).try_cast(FIELDS)


def read_line(line: Column | str) -> Column:
    """Struct of a flat line's fields and, for lines only the strict reader can judge, their text."""
    fields = flat_fields(line)
    return F.struct(fields.alias("fields"), F.when(fields.isNull(), _shaped(line)).alias("rest"))


def field_text(fields: Column | str, name: str) -> Column:
    """One plain field as text, ``''`` when absent."""
    return F.coalesce(F.try_element_at(col(fields), F.lit(name)).try_cast("string"), F.lit(""))


def printed_fields(fields: Column | str, leave_out: tuple[str, ...]) -> Column:
    """Array of ``name=value`` texts of a flat line in name order; truth values and null as words."""
    shown = F.map_filter(col(fields), lambda k, _: ~k.isin(*leave_out))

    def printed(entry: Column) -> Column:
        as_json = F.to_json(entry["value"])
        value = (
            F.when(as_json.startswith('"'), entry["value"].try_cast("string"))
            .when(as_json == "true", "True")
            .when(as_json == "false", "False")
            .when(as_json == "null", "None")
            .otherwise(as_json)
        )
        return F.concat(entry["key"], F.lit("="), value)

    return F.transform(F.map_entries(shown), printed)


def redact_fields(fields: Column | str) -> Column:
    """Hide the values of sensitive names of a flat line."""
    hidden = F.parse_json(F.lit(json.dumps(rules.REDACTED)))
    return F.transform_values(col(fields), lambda k, v: F.when(hides_column(k), hidden).otherwise(v))


def _object(line: str | None) -> dict | None:
    try:
        found = json.loads(line) if line else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


@F.pandas_udf(T.BooleanType())
def is_strict_object(lines: pd.Series) -> pd.Series:
    """Whether the strict reader takes the line for an object."""
    return lines.map(lambda line: _object(line) is not None)


def is_json_object(line: Column | str) -> Column:
    read = read_line(line)
    return read["fields"].isNotNull() | is_strict_object(read["rest"])


@F.pandas_udf(VIEWED)
def view_strictly(lines: pd.Series) -> pd.DataFrame:
    """Time, event and printed fields of lines only the strict reader can judge."""

    def one(line):
        fields = _object(line)
        if fields is None:
            return False, None, None, None
        ts, event = ("" if fields.get(k) is None else str(fields[k]) for k in ("ts", "event"))
        shown = (f"{k}={fields[k]}" for k in sorted(fields) if k not in ("ts", "event", "level"))
        return True, ts, event, ", ".join(shown)

    return pd.DataFrame([one(x) for x in lines], columns=["found", "ts", "event", "detail"])


def _redacted(top: dict) -> dict:
    """The object with hidden values replaced, level by level; lists carry the name above them."""
    open_parts = [(top, name, None) for name in top]
    while open_parts:
        holder, place, above = open_parts.pop()
        name = place if isinstance(holder, dict) else above
        if hides(name):
            holder[place] = rules.REDACTED
        elif name.strip().lower() not in rules.SAFE_LOG_KEYS:
            value = holder[place]
            if isinstance(value, dict):
                open_parts += [(value, inner, None) for inner in value]
            elif isinstance(value, list):
                open_parts += [(value, i, name) for i in range(len(value))]
    return top


@F.pandas_udf(T.StringType())
def redact_strictly(lines: pd.Series) -> pd.Series:
    """Redacted text of lines only the strict reader can judge; null for what is no object."""

    def one(line):
        fields = _object(line)
        if fields is None:
            return None
        return json.dumps(_redacted(fields), sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    return lines.map(one)
