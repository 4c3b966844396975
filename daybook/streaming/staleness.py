"""Staleness of keys as a stream: a key turns stale by the absence of rows, so a timer says so.

Per owner the state holds the newest rows that count (``STALE_LOOKBACK_ROWS``, a constant) and what was
last told of each of their keys.  A change comes out when a key is used, when it falls out of the newest
rows, and, through a timer, when its newest use has become too old.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daybook import rules
from daybook.operators.joins import apart

CHANGED = "who string, what string, change bigint, used bigint, stale boolean"
_LEAST = -(1 << 63)


def key_changes(
    history: DataFrame,
    owner: Sequence[str] = (),
    keys: Sequence[str] = ("provider", "model"),
    lateness: str = "10 minutes",
) -> DataFrame:
    """(owner, keys, change, last_used, stale): every change of a key's last use or staleness.

    ``change`` counts up per owner; a key's highest one is its present state as of the watermark.  Rows come
    in any order within ``lateness``; later ones are dropped by the watermark.  Rows without a time cannot
    make a key fresh and take no part.  An owner's rows pass through one task, which holds one Arrow batch
    and the newest rows only.  Start the query after ``admission.use_state_store(spark)``.
    """
    timed = (
        history.withColumn("_at", F.col("created_at").cast("timestamp"))
        .filter("_at IS NOT NULL")
        .select(
            (F.to_json(F.struct(*owner)) if owner else F.lit("{}")).alias("who"),
            F.to_json(F.struct(*keys)).alias("what"),
            F.unix_micros("_at").alias("at"),
            F.coalesce(F.col("id").cast("bigint"), F.lit(_LEAST)).alias("id"),
            F.col("_at").alias("event"),
        )
        .withWatermark("event", lateness)
    )
    watch = KeyWatch(rules.STALE_LOOKBACK_ROWS, rules.STALE_AFTER_MINUTES * 60_000_000)
    told = timed.groupBy("who").transformWithStateInPandas(watch, CHANGED, "append", "eventTime")

    def parts(column: str, names: Sequence[str]) -> list:
        read = F.from_json(column, T.StructType([history.schema[n] for n in names]))
        return [read[n].alias(n) for n in names]

    return told.select(
        *parts("who", owner), *parts("what", keys), "change", F.timestamp_micros("used").alias("last_used"), "stale"
    )


def stale_now(
    changes: DataFrame, wanted: DataFrame, owner: Sequence[str] = (), keys: Sequence[str] = ("provider", "model")
) -> DataFrame:
    """Wanted keys with ``last_used`` and ``stale`` by the stored changes; keys without any are stale."""
    names = [*owner, *keys]
    newest = F.max_by(F.struct("last_used", "stale"), "change").alias("_told")
    told = changes.groupBy(*names, apart(names)).agg(newest).drop("_apart")
    return wanted.join(told, names, "left").select(
        *wanted.columns, F.col("_told.last_used").alias("last_used"), F.coalesce("_told.stale", F.lit(True)).alias("stale")
    )


class KeyWatch(StatefulProcessor):
    """The newest rows of one owner at a time."""

    def __init__(self, rows: int, after_us: int):
        self.rows, self.after_us = rows, after_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at array<bigint>, id array<bigint>, what array<string>")
        self.told = handle.getMapState("told", "what string", "used bigint, stale boolean")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Take in rows batch by batch, keeping the newest, then tell what changed."""
        newest = self._held()
        for batch in rows:
            fresh = zip(batch["at"].tolist(), batch["id"].tolist(), batch["what"].tolist(), strict=True)
            newest = heapq.nlargest(self.rows, [*newest, *fresh])
        self.newest.update(tuple(list(column) for column in zip(*newest, strict=True)))
        return self._tell(key[0], newest, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._tell(key[0], self._held(), timerValues)

    def _held(self) -> list[tuple[int, int, str]]:
        return list(zip(*self.newest.get(), strict=True)) if self.newest.exists() else []

    def _tell(self, owner: str, newest: list[tuple[int, int, str]], timerValues) -> Iterator[pd.DataFrame]:
        """Rows for the keys whose state is another than was told, and timers for those still fresh."""
        edge = timerValues.getCurrentWatermarkInMs() * 1000 - self.after_us
        used: dict[str, int] = {}
        for at, _, what in newest:
            used[what] = max(at, used.get(what, at))
        before = {what: tuple(state) for (what,), state in self.told.iterator()}
        changed = []
        for what, at in used.items():
            now = (at, at < edge)
            if before.get(what) != now:
                changed.append((what, *now))
                self.told.updateValue((what,), now)
                if not now[1]:
                    self._watch(at)
        for what in before.keys() - used.keys():
            changed.append((what, None, True))
            self.told.removeKey((what,))
        if not changed:
            return
        n = self.count.get()[0] if self.count.exists() else 0
        self.count.update((n + len(changed),))
        yield pd.DataFrame(
            {
                "who": owner,
                "what": [what for what, _, _ in changed],
                "change": range(n + 1, n + len(changed) + 1),
                "used": pd.array([at for _, at, _ in changed], dtype="Int64"),
                "stale": [stale for _, _, stale in changed],
            }
        )

    def _watch(self, at: int) -> None:
        """Timers on both sides of the first millisecond at which a use is too old."""
        too_old = (at + self.after_us) // 1000 + 1
        self.handle.registerTimer(too_old - 1)
        self.handle.registerTimer(too_old)

    def close(self) -> None:
        pass
