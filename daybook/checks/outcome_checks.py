"""The chain from request to outcome against one statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.checks.answer_checks import _SCORED
from daybook.checks.fixtures import with_inputs
from daybook.checks.registry import query
from daybook.operators import attempts as oa
from daybook.plans.outcome import outcomes

_COOLING = "epoch_us(e.requested_at) - epoch_us(w.last_ts) < 14400000000"
_USED = "CASE WHEN w.last_day = CAST(e.requested_at AS DATE) THEN w.used ELSE 0 END"
_KEPT = f"({_COOLING}) OR {_USED} >= 2 OR e.made IS NULL"


@query(
    "run_outcome",
    "requests",
    "history",
    "attempts",
    "events",
    oracle=with_inputs(
        "requests",
        "history",
        "attempts",
        tables={
            "s": _SCORED.format(table="attempts"),
            "chosen": """SELECT s.run_id, s.response AS made, s.score AS made_score FROM s
  LEFT JOIN (SELECT run_id, min(attempt) AS n FROM s WHERE score >= 60 AND attempt <= 3 GROUP BY run_id) g
    ON g.run_id = s.run_id
  JOIN (SELECT run_id, max(attempt) AS n FROM s WHERE attempt <= 3 GROUP BY run_id) l ON l.run_id = s.run_id
  WHERE s.attempt = coalesce(g.n, l.n)""",
            "m": """SELECT r.*, ev.user_id, h.id, h.standup_text, h.quality_score, row_number() OVER
  (PARTITION BY r.request_id ORDER BY h.created_at DESC, h.id DESC) AS rn
  FROM requests r JOIN events ev ON ev.event_id = r.request_id
  LEFT JOIN history h ON h.commit_hash = r.commit_hash AND h.tone = r.tone
    AND h.provider = r.provider AND CAST(h.created_at AS DATE) = CAST(r.requested_at AS DATE)""",
            "looked": "SELECT * FROM m LEFT JOIN chosen ON run_id = request_id WHERE rn = 1",
            "e": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY requested_at, request_id) AS step
  FROM looked WHERE id IS NULL""",
            "w": f"""SELECT user_id, request_id, step, true AS admitted, '' AS reason,
    CASE WHEN made IS NOT NULL THEN requested_at END AS last_ts,
    CASE WHEN made IS NOT NULL THEN CAST(requested_at AS DATE) END AS last_day,
    CASE WHEN made IS NOT NULL THEN 1 ELSE 0 END AS used
  FROM e WHERE step = 1
  UNION ALL SELECT e.user_id, e.request_id, e.step,
    NOT coalesce({_COOLING}, false) AND {_USED} < 2,
    CASE WHEN coalesce({_COOLING}, false) THEN 'cooldown' WHEN {_USED} >= 2 THEN 'daily' ELSE '' END,
    CASE WHEN {_KEPT} THEN w.last_ts ELSE e.requested_at END,
    CASE WHEN {_KEPT} THEN w.last_day ELSE CAST(e.requested_at AS DATE) END,
    CASE WHEN {_KEPT} THEN w.used ELSE {_USED} + 1 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.step = w.step + 1""",
        },
        then="""SELECT l.request_id, l.user_id,
  CASE WHEN id IS NOT NULL THEN 'reused' WHEN NOT w.admitted THEN 'limited'
    WHEN made IS NULL THEN 'failed' ELSE 'generated' END AS outcome,
  coalesce(w.reason, '') AS reason,
  CASE WHEN id IS NOT NULL THEN standup_text WHEN w.admitted THEN made END AS text,
  CASE WHEN id IS NOT NULL THEN quality_score WHEN w.admitted THEN made_score END AS score
FROM looked l LEFT JOIN w ON w.request_id = l.request_id""",
    ),
)
def run_outcome(requests, history, attempts, events):
    asked = requests.join(events.select(F.col("event_id").alias("request_id"), "user_id"), "request_id")
    scored = oa.with_scores(attempts).withColumnRenamed("run_id", "request_id")
    return outcomes(asked, history.drop("user_id"), scored, 60, 240, 2)
