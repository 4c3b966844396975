"""Log lines: tail, printed view, redaction by field name, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook import rules
from daybook.functions import events as fe


def tail(lines: DataFrame, limit: int = 20, seq: str = "seq") -> DataFrame:
    """The last ``limit`` (1..500) lines, then without those that are no JSON object.

    Lines are taken before they are judged, so fewer than the limit may come back.
    """
    n = max(1, min(int(limit), rules.MAX_LOG_TAIL))
    last = lines.orderBy(F.col(seq).desc()).limit(n)
    return last.filter(fe.is_json_object("line")).orderBy(seq)


def _read(lines: DataFrame, *columns: str) -> DataFrame:
    """The columns with each line's ``fields`` and ``rest``; exploding binds one parse per line."""
    return lines.select(*columns, F.explode(F.array(fe.read_line("line"))).alias("_read")).select(
        *columns, "_read.*"
    )


def view(lines: DataFrame) -> DataFrame:
    """Printed listing of object lines: clock time, event, up to 120 characters of detail."""
    details = F.array_join(fe.printed_fields("fields", ("ts", "event", "level")), ", ")
    flat = F.col("fields").isNotNull()
    strict = _read(lines, "seq").withColumn("_strict", fe.view_strictly("rest"))
    return strict.filter(flat | F.col("_strict.found")).select(
        "seq",
        F.substring(F.when(flat, fe.field_text("fields", "ts")).otherwise(F.col("_strict.ts")), 12, 8).alias("time"),
        F.when(flat, fe.field_text("fields", "event")).otherwise(F.col("_strict.event")).alias("event"),
        F.left(F.when(flat, details).otherwise(F.col("_strict.detail")), F.lit(120)).alias("detail"),
    )


def redact(lines: DataFrame) -> DataFrame:
    """Object lines with sensitive fields hidden and keys sorted; other lines are dropped."""
    flat = F.to_json(fe.redact_fields("fields"))
    read = _read(lines, "seq").select("seq", flat.alias("_flat"), fe.redact_strictly("rest").alias("_strict"))
    return read.select("seq", F.coalesce("_flat", "_strict").alias("line")).filter(F.col("line").isNotNull())


def _field(name: str, value: Column, kind: T.DataType) -> Column:
    """A field as it may be written: names decide, so nested structs are settled here."""
    if name.strip().lower() in rules.SAFE_LOG_KEYS:
        return value
    if fe.hides(name):
        return F.lit(rules.REDACTED)
    if isinstance(kind, T.StructType):
        inner = [_field(f.name, value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.struct(*inner)
    return value


def encode(
    df: DataFrame,
    event: Column | str,
    ts: str = "ts",
    fields: Sequence[str] = (),
    level: str = "INFO",
) -> DataFrame:
    """One JSON line per row: ``ts``, ``level``, ``event`` and the given columns, keys sorted.

    Column names are known when the plan is made, so redaction costs nothing per row.
    """
    name = F.col(event) if isinstance(event, str) else event
    name = F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))
    out = {
        "ts": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        "level": F.lit(level),
        "event": name,
        **{f: _field(f, F.col(f), df.schema[f].dataType) for f in fields},
    }
    line = F.to_json(
        F.struct(*[out[k].alias(k) for k in sorted(out)]), {"ignoreNullFields": "false"}
    )
    return df.select("*", line.alias("line"))
