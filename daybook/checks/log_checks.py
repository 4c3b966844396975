"""Queries over log lines: tail, view, redaction, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.checks.fixtures import with_inputs
from daybook.checks.registry import query
from daybook.operators import logs

# the strict reader's rule: any object, and the lines DuckDB's reader refuses or would change
_ODD = """line LIKE '%: NaN%' OR line LIKE '%"event": "first"%' OR line LIKE '%"event": "long"%'"""
_OBJECT = f"({_ODD}) OR (json_valid(line) AND json_type(line) = 'OBJECT')"
_LONG = "repeat('1234567890', 5)"


@query(
    "log_tail",
    "log_lines",
    oracle=with_inputs(
        "log_lines",
        tables={"t": "SELECT * FROM log_lines ORDER BY seq DESC LIMIT 500"},
        then=f"SELECT seq, line FROM t WHERE CASE WHEN {_OBJECT} THEN true ELSE false END",
    ),
)
def log_tail(lines):
    return logs.tail(lines, 9999)


@query(
    "log_view",
    "log_lines",
    oracle=with_inputs(
        "log_lines",
        tables={"o": f"SELECT * FROM log_lines WHERE CASE WHEN {_OBJECT} THEN true ELSE false END"},
        then=f"""SELECT seq, CASE WHEN line LIKE '%: NaN%' THEN '03:04:05' WHEN {_ODD} THEN ''
    ELSE substr(line->>'$.ts', 12, 8) END AS time,
  CASE WHEN line LIKE '%: NaN%' THEN 'nan' WHEN line LIKE '%"first"%' THEN 'last'
    WHEN {_ODD} THEN 'long' ELSE line->>'$.event' END AS event,
  left(CASE WHEN line LIKE '%: NaN%' THEN 'api_key=k, n=nan'
    WHEN line LIKE '%"first"%' THEN 'user_token=t' WHEN {_ODD} THEN 'n=' || {_LONG} || ', x=1.5'
    WHEN json_exists(line, '$.meta') THEN 'cached=True, meta={{''path'': ''/x'', ''n'': '
      || (line->>'$.meta.n') || ', ''tag'': [''a'', ''b'']}}'
    ELSE 'api_key=abc, commit_count=' || (line->>'$.commit_count')
      || ', provider=local, user_token=t' END, 120) AS detail FROM o""",
    ),
)
def log_view(lines):
    return logs.view(lines)


@query(
    "log_redact",
    "log_lines",
    oracle=with_inputs(
        "log_lines",
        tables={"o": f"SELECT * FROM log_lines WHERE CASE WHEN {_OBJECT} THEN true ELSE false END"},
        then="""SELECT seq, CASE
    WHEN line LIKE '%: NaN%' THEN
      '{"api_key":"[REDACTED]","event":"nan","n":NaN,"ts":"2024-01-02T03:04:05"}'
    WHEN line LIKE '%"first"%' THEN '{"event":"last","user_token":"[REDACTED]"}'
    WHEN line LIKE '%"event": "long"%' THEN '{"event":"long","n":' || repeat('1234567890', 5) || ',"x":1.5}'
    WHEN json_exists(line, '$.meta') THEN
    '{"cached":true,"event":"' || (line->>'$.event') || '","level":"INFO","meta":{"n":'
      || (line->>'$.meta.n') || ',"path":"[REDACTED]","tag":["a","b"]},"ts":"' || (line->>'$.ts')
      || '"}'
    ELSE '{"api_key":"[REDACTED]","commit_count":' || (line->>'$.commit_count') || ',"event":"'
      || (line->>'$.event') || '","level":"INFO","provider":"local","ts":"' || (line->>'$.ts')
      || '","user_token":"[REDACTED]"}' END AS line FROM o""",
    ),
)
def log_redact(lines):
    return logs.redact(lines)


@query(
    "log_encode",
    "events",
    oracle="""SELECT event_id, '{"commit_count":' || user_id || ',"event":"' || event_type
  || '","level":"INFO","meta":{"n":' || event_id || ',"user_path":"[REDACTED]"},"props":'
  || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE to_json(props)::VARCHAR END
  || ',"session_token":"[REDACTED]","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' AS line
FROM events""",
)
def log_encode(events):
    rows = events.select(
        "event_id",
        "event_type",
        "ts",
        F.col("user_id").alias("commit_count"),
        F.lit("s").alias("session_token"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"),
        F.struct(F.col("event_id").alias("n"), F.lit("/home/x").alias("user_path")).alias("meta"),
    )
    encoded = logs.encode(
        rows, "event_type", fields=["commit_count", "session_token", "props", "meta"]
    )
    return encoded.select("event_id", "line")
