"""The per-user admission rule on sorted arrays, shared by the batch and stream forms."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DAY_US = 86_400_000_000
ADMITTED, COOLDOWN, DAILY = 0, 1, 2
REASONS = np.array(["", "cooldown", "daily"], dtype=object)


@dataclass
class LimitState:
    """What a user carries from one call to the next."""

    last: int | None = None  # microseconds of the last recorded call
    used: dict[int, int] = field(default_factory=dict)  # recorded calls per day number


def decide_sorted(
    ts: np.ndarray,
    done: np.ndarray,
    forced: np.ndarray,
    ok: np.ndarray,
    state: LimitState,
    cooldown_us: int,
    cap: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Reason code and whole seconds left for one user's calls in time order.

    Only admitted calls change the state, so the rows between two of them are
    decided as slices: the loop turns once per admitted call, not once per row.
    """
    n = len(ts)
    reason = np.zeros(n, dtype=np.int8)
    left = np.zeros(n, dtype=np.int64)
    free = np.flatnonzero(forced)
    i = 0
    while i < n:
        k = np.searchsorted(free, i)
        next_free = int(free[k]) if k < len(free) else n
        ready = i
        if state.last is not None:
            ready = max(i, int(np.searchsorted(ts, state.last + cooldown_us, side="left")))
        stop = min(ready, next_free, n)
        if stop > i:
            reason[i:stop] = COOLDOWN
            left[i:stop] = (state.last + cooldown_us - ts[i:stop]) // 1_000_000
        if stop == n:
            break
        i = stop
        day = int(ts[i] // DAY_US)
        if i != next_free and state.used.get(day, 0) >= cap:
            tomorrow = int(np.searchsorted(ts, (day + 1) * DAY_US, side="left"))
            stop = min(max(tomorrow, i + 1), next_free)
            reason[i:stop] = DAILY
            i = stop
            continue
        if ok[i]:
            state.last = int(done[i])
            done_day = state.last // DAY_US
            kept = {d: c for d, c in state.used.items() if d >= day}
            kept[done_day] = kept.get(done_day, 0) + 1
            state.used = kept
        i += 1
    return reason, left
