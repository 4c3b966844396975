"""Admission of calls as a keyed stateful stream, on Spark's state API for arbitrary processors.

A user's calls wait until the watermark has passed them, so that no earlier one can come, and are then
judged in time order.  State is kept apart by purpose: one value (the last recorded call), one map of
recorded calls by day, one map of waiting calls by slice of time and chunk.  A timer at the end of each
slice asks for its decision.  Only one slice of a user is ever in memory, besides one Arrow batch:
input goes into the state as it comes, and decided slices leave it one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daybook import rules
from daybook.functions.limits import DAY_US, REASONS, LimitState, decide_sorted
from daybook.operators.admission import prepared

#: The state store that Spark's state API needs; set for the session that runs the stream.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECIDED = "who string, id bigint, at bigint, admitted boolean, reason string, seconds_remaining bigint"
NO_ID = -(1 << 63)
#: Plain names: the state API hands rows over as named tuples, which hide names with an underscore.
_WAITING = ["at", "id", "done", "free", "ok"]


def use_state_store(spark) -> None:
    """Choose the state store these streams need, before they are started."""
    spark.conf.set(STORE_SETTING, STORE)


def admit_stream(
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
    lateness: str = "10 minutes",
    slice_minutes: int = 10,
) -> DataFrame:
    """(user, order, at, admitted, reason, seconds_remaining), each call once the watermark passed its slice.

    The result is that of the batch form whatever the order of files and the size of triggers.
    ``order`` is an integer column.  A call later than ``lateness`` allows is dropped by the watermark, as in
    any stream, and counted in the query's progress; one without a time or user is ``invalid`` at once.
    State is dropped slice by slice as calls are decided, and a user's last call and days once they
    cannot matter any more.  Start the query after ``use_state_store(spark)``.
    """
    facts = prepared(calls, user, ts, order, enabled, forced, succeeded, completed)
    judged = F.col("_at").isNotNull() & F.col("_user").isNotNull()
    timed = (
        facts.filter(judged)
        .select(
            F.col("_user").alias("who"),
            F.col("_at").alias("at"),
            F.coalesce(F.col("_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
            F.col("_done").alias("done"),
            F.col("_free").alias("free"),
            F.col("_ok").alias("ok"),
            F.col(ts).cast("timestamp").alias("event"),
        )
        .withWatermark("event", lateness)
    )
    limits = AdmissionLimits(int(cooldown_minutes) * 60_000_000, int(max_calls), int(slice_minutes) * 60_000_000)
    decided = timed.groupBy("who").transformWithStateInPandas(limits, DECIDED, "append", "eventTime")
    refused = facts.filter(~judged).select(
        user,
        order,
        F.lit(None).cast("timestamp").alias("at"),
        F.lit(False).alias("admitted"),
        F.lit("invalid").alias("reason"),
        F.lit(0).cast("bigint").alias("seconds_remaining"),
    )
    return decided.select(
        F.col("who").cast(calls.schema[user].dataType).alias(user),
        F.nullif(F.col("id"), F.lit(NO_ID)).cast(calls.schema[order].dataType).alias(order),
        F.timestamp_micros("at").alias("at"),
        "admitted",
        "reason",
        "seconds_remaining",
    ).unionByName(refused)


class AdmissionLimits(StatefulProcessor):
    """The rule for one user at a time."""

    def __init__(self, cooldown_us: int, cap: int, slice_us: int):
        self.cooldown_us, self.cap, self.slice_us = cooldown_us, cap, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")
        self.days = handle.getMapState("days", "day bigint", "used int")
        self.chunks = handle.getMapState("chunks", "slice bigint", "n int")
        self.waiting = handle.getMapState(
            "waiting",
            "slice bigint, chunk int",
            "at array<bigint>, id array<bigint>, done array<bigint>, free array<boolean>, ok array<boolean>",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Put calls into their slices' chunks; nothing is decided before its timer."""
        for batch in rows:
            for number, part in batch.groupby(batch["at"].to_numpy() // self.slice_us, sort=False):
                held = self.chunks.getValue((int(number),))
                n = held[0] if held else 0
                self.waiting.updateValue((int(number), n), tuple(part[c].tolist() for c in _WAITING))
                self.chunks.updateValue((int(number),), (n + 1,))
                if not n:
                    self.handle.registerTimer(self._end_ms(int(number)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Decide the slices that the watermark has passed, oldest first, then forget what cannot matter."""
        mark = timerValues.getCurrentWatermarkInMs()
        ready = sorted(n for (n,) in self.chunks.keys() if self._end_ms(n) <= mark)
        last = self.last.get() if self.last.exists() else None
        state = LimitState(last[0] if last else None, {d: used for (d,), (used,) in self.days.iterator()})
        for number in ready:
            yield self._decide(key[0], number, state)
        self._keep(state, mark)

    def _end_ms(self, number: int) -> int:
        return (number + 1) * self.slice_us // 1000

    def _decide(self, user: str, number: int, state: LimitState) -> pd.DataFrame:
        (n,) = self.chunks.getValue((number,))
        chunks = [self.waiting.getValue((number, i)) for i in range(n)]
        at, ids, done, free, ok = (
            np.concatenate([np.asarray(c[k], kind) for c in chunks])
            for k, kind in enumerate(("int64", "int64", "int64", bool, bool))
        )
        order = np.lexsort((ok, free, done, ids, at))
        at, ids, done, free, ok = at[order], ids[order], done[order], free[order], ok[order]
        reason, left = decide_sorted(at, done, free, ok, state, self.cooldown_us, self.cap)
        for i in range(n):
            self.waiting.removeKey((number, i))
        self.chunks.removeKey((number,))
        return pd.DataFrame(
            {
                "who": user,
                "id": ids,
                "at": at,
                "admitted": reason == 0,
                "reason": REASONS[reason],
                "seconds_remaining": left,
            }
        )

    def _keep(self, state: LimitState, mark_ms: int) -> None:
        """Store what can still matter and set a timer for when it no longer can."""
        mark = mark_ms * 1000
        used = {d: n for d, n in state.used.items() if (d + 1) * DAY_US > mark}
        for (day,) in list(self.days.keys()):
            if day not in used:
                self.days.removeKey((day,))
        for day, n in used.items():
            self.days.updateValue((int(day),), (int(n),))
        ends = [(d + 1) * DAY_US for d in used]
        if state.last is not None and state.last + self.cooldown_us > mark:
            self.last.update((int(state.last),))
            ends.append(state.last + self.cooldown_us)
        elif self.last.exists():
            self.last.clear()
        if ends:
            self.handle.registerTimer(-(-max(ends) // 1000))

    def close(self) -> None:
        pass
