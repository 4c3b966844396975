"""Queries over call facts: daily usage, report, pruning, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.checks.fixtures import EVENTS_NOW, with_inputs
from daybook.checks.registry import query
from daybook.operators import usage
from daybook.operators.admission import admit

_DAILY = """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, max(ts) AS last_call
FROM calls GROUP BY ALL"""


@query("usage_daily", "calls", oracle=with_inputs("calls", then=_DAILY))
def usage_daily(calls):
    return usage.daily(calls)


@query(
    "usage_prune",
    "calls",
    oracle=with_inputs(
        "calls",
        tables={"d": _DAILY},
        then="SELECT user_id, day, calls FROM d WHERE day >= DATE '2024-02-14' - 30",
    ),
)
def usage_prune(calls):
    return usage.prune(usage.daily(calls), "2024-02-14 09:00:00").select("user_id", "day", "calls")


_SEVEN = [f"2024-01-{d}" for d in range(25, 32)]
_DAY_COUNTS = ", ".join(
    f"count(ts) FILTER (CAST(ts AS DATE) = DATE '{d}') AS d{i}" for i, d in enumerate(_SEVEN)
)
_BARS = " || ".join(
    f"CASE WHEN d{i} > 0 THEN substr('▁▂▃▄▅▆▇█', CAST(floor(d{i}::DOUBLE / most * 7) AS INT) + 1, 1)"
    " ELSE ' ' END"
    for i in range(7)
)
_DAY_LINES = " || ".join(
    f"chr(10) || '  {d}: ' || d{i} || ' call(s)'" for i, d in enumerate(_SEVEN)
)


@query(
    "usage_report",
    "customer",
    "calls",
    oracle=with_inputs(
        "calls",
        tables={
            "counts": f"""SELECT c_custkey AS user_id, {_DAY_COUNTS}, count(ts) AS total_all,
  max(ts) AS last_ts FROM customer LEFT JOIN calls ON user_id = c_custkey GROUP BY c_custkey""",
            "facts": """SELECT *, d0 + d1 + d2 + d3 + d4 + d5 + d6 AS total_7d,
  greatest(d0, d1, d2, d3, d4, d5, d6, 1) AS most,
  coalesce(strftime(last_ts, '%Y-%m-%dT%H:%M:%S.%f'), 'Never') AS last_call FROM counts""",
            "drawn": f"SELECT *, {_BARS} AS spark FROM facts",
        },
        then=f"""SELECT user_id, spark, total_7d, total_all, last_call,
  '📊 Usage Report' || chr(10) || repeat('─', 32) || chr(10) || 'Last 7 days: [' || spark || ']'
  || {_DAY_LINES} || chr(10) || repeat('─', 32) || chr(10) || 'Total (7d): ' || total_7d || ' calls'
  || chr(10) || 'Total (all): ' || total_all || ' calls' || chr(10) || 'Last call:   ' || last_call
  AS report FROM drawn""",
    ),
)
def usage_report(customer, calls):
    users = customer.select(F.col("c_custkey").alias("user_id"))
    return usage.report(users, calls, EVENTS_NOW).drop("counts")


_COOLING = "epoch_us(e.ts) - epoch_us(w.last_ts) < 14400000000"
_USED = "CASE WHEN w.last_day = CAST(e.ts AS DATE) THEN w.used ELSE 0 END"


@query(
    "admission",
    "calls",
    oracle=with_inputs(
        "calls",
        tables={
            "e": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, call_id) AS step
FROM calls""",
            "w": f"""SELECT user_id, call_id, step, true AS admitted, '' AS reason,
    0::BIGINT AS seconds_remaining, ts AS last_ts, CAST(ts AS DATE) AS last_day, 1 AS used
  FROM e WHERE step = 1
  UNION ALL SELECT e.user_id, e.call_id, e.step, NOT ({_COOLING}) AND {_USED} < 2,
    CASE WHEN {_COOLING} THEN 'cooldown' WHEN {_USED} >= 2 THEN 'daily' ELSE '' END,
    CASE WHEN {_COOLING} THEN (epoch_us(w.last_ts) + 14400000000 - epoch_us(e.ts)) // 1000000
      ELSE 0 END,
    CASE WHEN {_COOLING} OR {_USED} >= 2 THEN w.last_ts ELSE e.ts END,
    CASE WHEN {_COOLING} OR {_USED} >= 2 THEN w.last_day ELSE CAST(e.ts AS DATE) END,
    CASE WHEN {_COOLING} OR {_USED} >= 2 THEN w.used ELSE {_USED} + 1 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.step = w.step + 1""",
        },
        then="SELECT user_id, call_id, admitted, reason, seconds_remaining FROM w",
    ),
)
def admission(calls):
    return admit(calls, cooldown_minutes=240, max_calls=2).drop("ts")
