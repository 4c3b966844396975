"""Admission of calls under a cooldown and a daily limit, decided per user in time order.

The rule is a greedy recursion: a call is judged against the last call that was recorded.  Every
user's weeks are walked apart, in time order and with constant memory, so a user with very many
calls is as many units of work as weeks.  A week depends on the weeks before it only through its
entry state: the last recorded call, where its cooldown reaches into the week, and calls recorded
into its days from before.  Weeks are first walked from a fresh state; those whose real entry state
differs are walked again, until none is left.  Turns follow how far a change travels from week to
week, never the number of calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook import rules
from daybook.functions.limits import DAY_US, REASONS, LimitState, decide_sorted
from daybook.session import checkpointed

DAYS = 7
WEEK = ["_user", "_week"]
#: What a call is judged by, in the order calls are judged.
FACTS = ["_at", "_id", "_done", "_free", "_ok"]
_USED = "array<struct<day:bigint,used:int>>"


def admit(
    calls: DataFrame,
    cooldown_minutes: int = rules.DEFAULT_COOLDOWN_MINUTES,
    max_calls: int = rules.DEFAULT_CALLS_PER_DAY,
    user: str = "user_id",
    ts: str = "ts",
    order: str = "call_id",
    enabled: str | None = None,
    forced: str | None = None,
    succeeded: str | None = None,
    completed: str | None = None,
) -> DataFrame:
    """Calls with ``admitted``, ``reason`` and ``seconds_remaining``.

    Ties in time go by ``order``, then by completion and the flags.  Calls that are forced, or not
    ``enabled`` for limiting, skip the checks; every admitted call that succeeded is recorded, at
    its completion time where there is one.  A call without a time or a user is refused as ``invalid``.
    """
    plan = prepared(calls, user, ts, order, enabled, forced, succeeded, completed)
    cooldown_us, cap = int(cooldown_minutes) * 60_000_000, int(max_calls)
    given = list(dict.fromkeys([user, order, ts]))
    judged = F.col("_at").isNotNull() & F.col("_user").isNotNull()
    timed = plan.filter(judged).withColumn("_week", F.floor(F.col("_at") / (DAYS * DAY_US)))
    refused = plan.filter(~judged).select(
        *given, F.lit("invalid").alias("_reason"), F.lit(0).cast("bigint").alias("_left")
    )
    # the only reading of the calls: all weeks from a fresh state, with what they were judged by
    walked = checkpointed(_walk(timed, given, cooldown_us, cap).unionByName(refused, allowMissingColumns=True))
    entries = _entries_of_weeks(walked, cooldown_us, cap)
    decided = walked.filter(F.col("_exit").isNull())
    if entries is not None:
        again = walked.filter(F.col("_exit").isNull()).join(entries, WEEK)
        redone = _walk(again, given, cooldown_us, cap, exits=False)
        decided = decided.join(entries.select(*WEEK), WEEK, "left_anti").unionByName(redone, allowMissingColumns=True)
    return decided.select(
        *given,
        (F.col("_reason") == "").alias("admitted"),
        F.col("_reason").alias("reason"),
        F.col("_left").alias("seconds_remaining"),
    )


def _micros(calls: DataFrame, column: str) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast(calls.schema[column].dataType)
    return F.timestamp_diff("MICROSECOND", epoch, F.col(column))


def prepared(calls, user, ts, order, enabled, forced, succeeded, completed) -> DataFrame:
    at = _micros(calls, ts)
    skips = F.lit(False)
    if forced:
        skips = skips | F.coalesce(forced, F.lit(False))
    if enabled:
        skips = skips | ~F.coalesce(enabled, F.lit(True))
    return calls.select(
        F.col(user).cast("string").alias("_user"),
        at.alias("_at"),
        F.col(order).alias("_id"),
        F.coalesce(_micros(calls, completed), at).alias("_done") if completed else at.alias("_done"),
        skips.alias("_free"),
        (F.coalesce(succeeded, F.lit(True)) if succeeded else F.lit(True)).alias("_ok"),
        user,
        ts,
        *([order] if order not in (user, ts) else []),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Each week of a user in one task, in the order calls are judged."""
    return rows.repartition(*WEEK).sortWithinPartitions(*WEEK, *FACTS)


def _judged(
    batches: Iterator[pd.DataFrame], cooldown_us: int, cap: int
) -> Iterator[tuple[pd.DataFrame, list[tuple], np.ndarray, np.ndarray]]:
    """Batches with their week parts (start, user, week, entry, state), reasons and seconds left.

    A part's state is the week's state after it; a week may go on in the next batch.
    """
    current, state, entry = None, LimitState(), None
    for batch in batches:
        users, weeks, *facts = (batch[c].to_numpy() for c in (*WEEK, "_at", "_done", "_free", "_ok"))
        given = [batch[c].to_numpy() if c in batch else None for c in ("_entry_last", "_entry_used")]
        edges = np.flatnonzero((users[1:] != users[:-1]) | (weeks[1:] != weeks[:-1])) + 1
        parts, reasons, lefts = [], [], []
        for start, stop in zip([0, *edges], [*edges, len(users)], strict=True):
            if start == stop:
                continue
            key = (users[start], int(weeks[start]))
            if key != current:
                last, used = (None if g is None else g[start] for g in given)
                entry = None if last is None or pd.isna(last) else int(last)
                days = {int(u["day"]): int(u["used"]) for u in used} if used is not None else {}
                current, state = key, LimitState(entry, days)
            reason, left = decide_sorted(*(f[start:stop] for f in facts), state, cooldown_us, cap)
            parts.append((start, *key, entry, state))
            reasons.append(reason)
            lefts.append(left)
        if parts:
            yield batch, parts, np.concatenate(reasons), np.concatenate(lefts)


_EXIT = f"struct<_first:bigint,_last:bigint,_later:{_USED}>"


def _walk(rows: DataFrame, given: list[str], cooldown_us: int, cap: int, decisions: bool = True, exits: bool = True) -> DataFrame:
    """Every call's decision, from the entry state its row carries, and one more row a week.

    That row has the week's ``_exit``: its first call, the last recorded call where it is not the entry
    state's, and calls recorded into later weeks.
    """
    facts = [*WEEK, *FACTS]
    kept = list(dict.fromkeys([*(given if decisions else []), *facts]))
    schema = T.StructType(
        [T.StructField(c, rows.schema[c].dataType) for c in kept]
        + [T.StructField("_reason", T.StringType()), T.StructField("_left", T.LongType())]
        + [T.StructField("_exit", T._parse_datatype_string(_EXIT))]
    )
    names = schema.names

    def closing(weeks: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([None] * len(weeks), dtype=object) for c in names})
        out["_user"] = [user for _, user, _, _, _ in weeks]
        out["_week"] = [number for _, _, number, _, _ in weeks]
        out["_exit"] = [
            {
                "_first": first,
                "_last": None if state.last == entry else state.last,
                "_later": [{"day": d, "used": n} for d, n in sorted(state.used.items()) if d // DAYS > number],
            }
            for first, _, number, entry, state in weeks
        ]
        return out

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        going = None  # the week that may go on in the next batch
        for batch, parts, reason, left in _judged(batches, cooldown_us, cap):
            at, closed = batch["_at"].to_numpy(), []
            for start, user, week, entry, state in parts:
                if going and going[1:3] == (user, week):
                    continue
                if going:
                    closed.append(going)
                going = (int(at[start]), user, week, entry, state)
            if decisions:
                yield batch[kept].assign(_reason=REASONS[reason], _left=left, _exit=None)
            if exits and closed:
                yield closing(closed)
        if exits and going:
            yield closing([going])

    return _in_order(rows).mapInPandas(walk, schema)


def _exits(walked: DataFrame) -> DataFrame:
    return walked.filter(F.col("_exit").isNotNull()).select(*WEEK, "_exit.*")


def _entries_of_weeks(walked: DataFrame, cooldown_us: int, cap: int) -> DataFrame | None:
    """(user, week, entry state) of the weeks that do not start fresh; None where all do.

    ``walked`` has all weeks' calls and their exits from a fresh state.  Only weeks whose entry differs
    from the one they were walked from are walked again.
    """
    facts = walked.filter(F.col("_exit").isNull()).select(*WEEK, *FACTS)
    fresh = {"_entry_last": F.lit(None).cast("bigint"), "_entry_used": F.array().cast(_USED)}
    solved, turned = _exits(walked).withColumns(fresh), False
    while True:
        state = checkpointed(_with_next_entry(solved, cooldown_us))
        again = state.filter("_differs")
        if again.isEmpty():
            starts_fresh = F.col("_entry_last").isNull() & (F.size("_entry_used") == 0)
            return state.filter(~starts_fresh).select(*WEEK, "_entry_last", "_entry_used") if turned else None
        entry = again.select(*WEEK, F.col("_next_last").alias("_entry_last"), F.col("_next_used").alias("_entry_used"))
        redone = _exits(_walk(facts.join(entry, WEEK), [], cooldown_us, cap, decisions=False)).join(entry, WEEK)
        solved, turned = state.filter("NOT _differs").select(*solved.columns).unionByName(redone), True


def _with_next_entry(solved: DataFrame, cooldown_us: int) -> DataFrame:
    """Weeks with the state they should start from, reduced to what can matter in that week."""
    earlier = (
        Window.partitionBy("_user").orderBy("_week").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = F.last("_last", ignorenulls=True).over(earlier)
    day = F.col("_l.day")
    spilled = (
        solved.select("_user", F.explode("_later").alias("_l"))
        .groupBy("_user", day.alias("day"))
        .agg(F.sum("_l.used").cast("int").alias("used"))
        .groupBy("_user", F.floor(F.col("day") / DAYS).alias("_week"))
        .agg(F.array_sort(F.collect_list(F.struct("day", "used"))).alias("_spilled"))
    )
    matters = F.col("_carried") + cooldown_us > F.col("_first")
    differs = ~(
        F.col("_entry_last").eqNullSafe(F.col("_next_last")) & (F.col("_entry_used") == F.col("_next_used"))
    )
    return (
        solved.withColumn("_carried", carried)
        .join(spilled, WEEK, "left")
        .withColumns(
            {
                "_next_last": F.when(matters, F.col("_carried")),
                "_next_used": F.coalesce("_spilled", F.array().cast(_USED)),
            }
        )
        .withColumn("_differs", differs)
        .drop("_carried", "_spilled")
    )
