"""Queries over history rows: decoding, reuse, listing, retention, staleness."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from daybook.checks.fixtures import EVENTS_NOW, with_inputs
from daybook.checks.registry import query
from daybook.operators import history as oh
from daybook.operators.times import before
from daybook.plans.maintenance import prune_history, purge_history
from daybook.session import shared_folder
from daybook.sources.tables import append_history, read_history

_DATED = """SELECT *, CAST(created_at AS DATE) AS day FROM history"""


@query(
    "history_decode",
    "history",
    oracle=with_inputs(
        "history",
        then="""SELECT id, CASE WHEN json_valid(repos) THEN
  array_to_string(json_extract_string(repos, '$[*]'), ',') ELSE '' END AS repos,
  quality_score FROM history""",
    ),
)
def history_decode(history):
    return oh.decode(history).select(
        "id", F.array_join("repos", ",").alias("repos"), "quality_score"
    )


@query(
    "history_view",
    "history",
    oracle=with_inputs(
        "history",
        then="""SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M') AS date,
  CASE WHEN json_valid(repos) THEN array_to_string(json_extract_string(repos, '$[*]'), ', ')
    ELSE '' END AS repos, provider, left(replace(standup_text, chr(10), ' '), 80) AS preview
FROM history""",
    ),
)
def history_view(history):
    return oh.view(history)


_KEYS = "h.commit_hash = r.commit_hash AND h.tone = r.tone AND h.provider = r.provider AND h.day = r.day"


@query(
    "cache_lookup",
    "requests",
    "history",
    oracle=with_inputs(
        "requests",
        "history",
        tables={
            "h": _DATED,
            "r": "SELECT *, CAST(requested_at AS DATE) AS day FROM requests",
            "m": f"""SELECT r.request_id, h.id, h.standup_text, h.quality_score, row_number() OVER
  (PARTITION BY r.request_id ORDER BY h.created_at DESC, h.id DESC) AS rn
FROM r LEFT JOIN h ON {_KEYS}""",
        },
        then="""SELECT request_id, id IS NOT NULL AS hit, id AS history_id,
  standup_text AS reused_text, quality_score AS reused_score FROM m WHERE rn = 1""",
    ),
)
def cache_lookup(requests, history):
    return oh.find_reusable(requests, history).select(
        "request_id", "hit", "history_id", "reused_text", "reused_score"
    )


@query(
    "cache_miss",
    "requests",
    "history",
    oracle=with_inputs(
        "requests",
        "history",
        tables={"h": _DATED, "r": "SELECT *, CAST(requested_at AS DATE) AS day FROM requests"},
        then=f"SELECT request_id FROM r WHERE NOT EXISTS (SELECT 1 FROM h WHERE {_KEYS})",
    ),
)
def cache_miss(requests, history):
    return oh.find_missing(requests, history).select("request_id")


@query(
    "history_topn",
    "history",
    oracle=with_inputs(
        "history",
        then="SELECT id, model FROM history ORDER BY created_at DESC, id DESC LIMIT 100",
    ),
)
def history_topn(history):
    return oh.newest(history, 5000).select("id", "model")


_RANKED = """SELECT *, row_number() OVER (PARTITION BY provider ORDER BY created_at DESC, id DESC)
  AS rn FROM history"""


@query(
    "retention_keep",
    "history",
    oracle=with_inputs(
        "history", tables={"k": _RANKED}, then="SELECT provider, id FROM k WHERE rn <= 365"
    ),
)
def retention_keep(history):
    return oh.keep_newest(history, ["provider"]).select("provider", "id")


@query(
    "retention_deleted",
    "history",
    oracle=with_inputs(
        "history", tables={"k": _RANKED}, then="SELECT provider, id FROM k WHERE rn > 365"
    ),
)
def retention_deleted(history):
    return oh.beyond_ceiling(history, ["provider"]).select("provider", "id")


@query(
    "retention_counts",
    "history",
    oracle=with_inputs(
        "history",
        then="""SELECT provider, model, CASE WHEN count(*) > 365 THEN count(*) - 365 END AS deleted
FROM history GROUP BY provider, model""",
    ),
)
def retention_counts(history):
    return oh.deleted_counts(history, ["provider", "model"])


@query(
    "age_purge",
    "history",
    oracle=with_inputs(
        "history",
        then=f"""SELECT id FROM history
WHERE created_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 DAY""",
    ),
)
def age_purge(history):
    return oh.purge(history, EVENTS_NOW, 10).select("id")


def _stored(history) -> str:
    """The rows as a history table of their own below the shared folder."""
    path = f"{shared_folder(history.sparkSession)}/history-{uuid.uuid4().hex}"
    append_history(history.withColumn("repos", oh.decode_repos("repos")), path)
    return path


@query(
    "retention_in_place",
    "history",
    oracle=with_inputs(
        "history",
        tables={"k": _RANKED},
        then="SELECT provider, id, CAST(created_at AS DATE) AS day FROM k WHERE rn <= 365",
    ),
)
def retention_in_place(history):
    """The table on disk after its days were rewritten or dropped."""
    path = _stored(history)
    prune_history(history.sparkSession, path, ["provider"])
    return read_history(history.sparkSession, path).select("provider", "id", F.col("created_date").alias("day"))


@query(
    "purge_in_place",
    "history",
    oracle=with_inputs(
        "history",
        then=f"""SELECT id, CAST(created_at AS DATE) AS day FROM history
WHERE date_trunc('second', created_at) >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 235 HOUR""",
    ),
)
def purge_in_place(history):
    """The same for an age limit whose edge lies within a day."""
    path = _stored(history)
    purge_history(history.sparkSession, path, before(EVENTS_NOW, hours=-5), 10)
    return read_history(history.sparkSession, path).select("id", F.col("created_date").alias("day"))


@query(
    "history_count",
    "history",
    oracle=with_inputs("history", then="SELECT count(*) AS n FROM history"),
)
def history_count(history):
    return oh.count_rows(history)


@query(
    "max_version",
    "part",
    oracle="SELECT coalesce(max(p_size), 0) AS version FROM part",
)
def max_version(part):
    return oh.highest_version(part, "p_size")


_WANTED = """SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'cloud' END
  AS provider, 'm' || CAST(event_id % 4 AS STRING) AS model FROM {events}"""


@query(
    "stale_keys",
    "history",
    "events",
    oracle=with_inputs(
        "history",
        tables={
            "wanted": _WANTED.format(events="events"),
            "k": """SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, id DESC) AS rn FROM history""",
            "used": """SELECT user_id, provider, model, max(created_at) AS last_used FROM k
WHERE rn <= 25 GROUP BY ALL""",
        },
        then="""SELECT w.user_id, w.provider, w.model,
  last_used IS NULL OR last_used < TIMESTAMP '2024-01-24 00:00:00' - INTERVAL 60 MINUTE AS stale
FROM wanted w LEFT JOIN used u ON u.user_id = w.user_id AND u.provider = w.provider
  AND u.model = w.model""",
    ),
)
def stale_keys(history, events):
    wanted = events.selectExpr(
        "user_id",
        "CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS provider",
        "'m' || event_id % 4 AS model",
    ).distinct()
    return oh.stale_keys(history, wanted, "2024-01-24 00:00:00", owner=["user_id"]).select(
        "user_id", "provider", "model", "stale"
    )


@query(
    "tag_prefix_match",
    "part",
    oracle="""WITH names AS (SELECT DISTINCT lower(p_brand) || ':' || p_size
    || CASE WHEN p_partkey % 2 = 0 THEN ':q' || (p_partkey % 4) ELSE '' END AS name FROM part),
wanted AS (SELECT DISTINCT lower(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE
    ':' || p_size END AS model FROM part)
SELECT model, name FROM wanted JOIN names ON name = model OR starts_with(name, model || ':')""",
)
def tag_prefix_match(part):
    names = part.selectExpr(
        "lower(p_brand) || ':' || p_size || CASE WHEN p_partkey % 2 = 0 "
        "THEN ':q' || p_partkey % 4 ELSE '' END AS name"
    ).distinct()
    wanted = part.selectExpr(
        "lower(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ':' || p_size END AS model"
    )
    return oh.match_tagged_names(names, wanted)
