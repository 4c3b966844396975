"""Queries over free text: cleaning, caps, redaction, masking, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.checks import sqltext as q
from daybook.checks.fixtures import with_inputs
from daybook.checks.registry import query
from daybook.functions import text as ft


@query(
    "clean_text",
    "documents",
    oracle=f"""SELECT doc_id, left(regexp_replace({q.strip("replace(text, chr(0), '')")},
  ' {{2,}}', ' ', 'g'), 500) AS cleaned FROM documents""",
)
def clean_text(documents):
    return documents.select("doc_id", ft.clean_text("text").alias("cleaned"))


@query(
    "storage_clean",
    "history",
    "documents",
    oracle=with_inputs(
        "history",
        tables={
            "texts": """SELECT 'h' || id AS id, standup_text AS text FROM history
UNION ALL SELECT 'd' || doc_id, replace(text, chr(10), chr(13)) FROM documents"""
        },
        then="""SELECT id, left(replace(replace(replace(text, chr(0), ''), chr(13) || chr(10), chr(10)),
  chr(13), chr(10)), 4000) AS stored FROM texts""",
    ),
)
def storage_clean(history, documents):
    texts = history.selectExpr("'h' || id AS id", "standup_text AS text").unionByName(
        documents.selectExpr("'d' || doc_id AS id", "replace(text, chr(10), chr(13)) AS text")
    )
    return texts.select("id", ft.storage_clean("text").alias("stored"))


@query(
    "response_cap",
    "conversations",
    "documents",
    oracle="""SELECT id, left(text, 8000) AS response, length(text) > 8000 AS truncated FROM (
  SELECT 'c' || conv_id || '/' || turn AS id, text FROM conversations
  UNION ALL SELECT 'd' || doc_id, text FROM documents)""",
)
def response_cap(conversations, documents):
    texts = conversations.selectExpr("'c' || conv_id || '/' || turn AS id", "text").unionByName(
        documents.selectExpr("'d' || doc_id AS id", "text")
    )
    return texts.select(
        "id",
        ft.response_cap("text").alias("response"),
        ft.response_truncated("text").alias("truncated"),
    )


def _texts(documents, commits):
    return documents.selectExpr("'d' || doc_id AS id", "text").unionByName(
        commits.selectExpr("'c' || seq AS id", "message AS text")
    )


_TEXTS = {
    "texts": """SELECT 'd' || doc_id AS id, text FROM documents
UNION ALL SELECT 'c' || seq, message FROM commits"""
}


@query(
    "redact_text",
    "documents",
    "commits",
    oracle=with_inputs(
        "commits", tables=_TEXTS, then=f"SELECT id, {q.redact('text')} AS redacted FROM texts"
    ),
)
def redact_text(documents, commits):
    return _texts(documents, commits).select("id", ft.redact_counted("text")["text"].alias("redacted"))


@query(
    "redaction_counts",
    "documents",
    "commits",
    oracle=with_inputs(
        "commits",
        tables=_TEXTS | q.redaction_steps("texts", "id", "text"),
        then="SELECT id, hits::INTEGER AS hits FROM r10 WHERE hits > 0",
    ),
)
def redaction_counts(documents, commits):
    counted = _texts(documents, commits).select("id", ft.redact_counted("text")["hits"].alias("hits"))
    return counted.filter("hits > 0")


@query(
    "error_clean",
    "error_texts",
    oracle=with_inputs(
        "error_texts",
        tables={
            "scrubbed": r"""SELECT error_id, error_class, trim(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(message,
    '[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*', '[REDACTED]', 'g'),
    '(?:/home/|/Users/)[^/\s]+(?:/[^\s]*)?', '[REDACTED]', 'g'),
    '[^@\s]+@[^@\s]+\.[^@\s]+', '[REDACTED]', 'g'),
    'gsk_[A-Za-z0-9_\-]{10,}', '[REDACTED]', 'g'), '\s+', ' ', 'g')) AS m FROM error_texts"""
        },
        then="""SELECT error_id, CASE error_class
  WHEN 'FileNotFoundError' THEN 'A required file or directory could not be found.'
  WHEN 'PermissionError' THEN 'Permission was denied while accessing a required file or directory.'
  WHEN 'TimeoutError' THEN 'The operation timed out.'
  WHEN 'JSONDecodeError' THEN 'Invalid JSON content was encountered.'
  WHEN 'sqlite3.Error' THEN 'The local history database could not be accessed safely.'
  ELSE CASE WHEN m = '' THEN 'An unexpected error occurred.'
    WHEN length(m) > 200 THEN rtrim(left(m, 200)) || '...' ELSE m END END AS shown FROM scrubbed""",
    ),
)
def error_clean(errors):
    return errors.select("error_id", ft.error_clean("message", "error_class").alias("shown"))


@query(
    "mask_key",
    "keys",
    oracle=with_inputs(
        "keys",
        then="""SELECT owner, CASE WHEN length(key) < 14 THEN '****'
  ELSE left(key, 10) || repeat('*', length(key) - 14) || right(key, 4) END AS masked FROM keys""",
    ),
)
def mask_key(keys):
    return keys.select("owner", ft.mask_key("key").alias("masked"))


@query(
    "key_format",
    "keys",
    oracle=with_inputs(
        "keys",
        then="SELECT owner, left(key, 4) = 'gsk' || '_' AND length(key) >= 40 AS valid FROM keys",
    ),
)
def key_format(keys):
    return keys.select("owner", ft.key_format_ok("key").alias("valid"))



@query(
    "size_band",
    "lineitem",
    oracle="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_bytes,
  CASE WHEN n_bytes < 1024 THEN n_bytes || ' B'
    WHEN n_bytes < 1048576 THEN printf('%.1f KB', n_bytes / 1024.0)
    ELSE printf('%.2f MB', n_bytes / 1048576.0) END AS size,
  CASE WHEN n_bytes > 20971520 THEN 'fail' WHEN n_bytes > 5242880 THEN 'warn' ELSE 'pass' END AS band
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
  WHEN 1 THEN l_partkey WHEN 2 THEN l_partkey * 128
  ELSE CAST(floor(l_extendedprice) AS BIGINT) * l_linenumber * l_linenumber * 16 END AS n_bytes
  FROM lineitem)""",
)
def size_band(lineitem):
    n_bytes = F.expr(
        "CASE l_linenumber WHEN 1 THEN l_partkey WHEN 2 THEN l_partkey * 128 "
        "ELSE CAST(floor(l_extendedprice) AS BIGINT) * l_linenumber * l_linenumber * 16 END"
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sized = lineitem.select(*keys, n_bytes.alias("n_bytes"))
    return sized.select(
        "*", ft.size_text("n_bytes").alias("size"), ft.size_band("n_bytes").alias("band")
    )


_WORD = (
    "CASE user_id % 9 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'y' WHEN 3 THEN '1' "
    "WHEN 4 THEN 'no' WHEN 5 THEN '' WHEN 6 THEN event_type WHEN 7 THEN 'y  es' ELSE '0' END"
)


@query(
    "parse_bool",
    "events",
    oracle=f"""SELECT event_id, lower(trim({_WORD})) IN ('true', 'yes', 'y', '1') AS answer
FROM events""",
)
def parse_bool(events):
    return events.select("event_id", ft.parse_bool(F.expr(_WORD)).alias("answer"))
