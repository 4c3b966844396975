"""Hits spend no limit; misses are limited, generated or failed."""

from datetime import datetime

import pytest

from daybook.plans import outcome
from daybook.plans.outcome import outcomes, record_outcomes
from daybook.sources.tables import read_calls, read_history

DAY = datetime(2024, 1, 1)


def test_a_hit_spends_no_limit(spark):
    asked = [
        (1, 7, "h1", DAY.replace(hour=1)),
        (2, 7, "h2", DAY.replace(hour=2)),
        (3, 7, "h3", DAY.replace(hour=3)),
        (4, 7, "h4", DAY.replace(hour=4)),
        (5, 7, "h5", None),
    ]
    names = "request_id bigint, user_id bigint, commit_hash string, requested_at timestamp_ntz"
    requests = spark.createDataFrame(asked, names).selectExpr("*", "'casual' AS tone", "'local' AS provider")
    history = spark.createDataFrame(
        [(9, "h1", "casual", "local", DAY, "stored", 70)],
        "id bigint, commit_hash string, tone string, provider string, created_at timestamp_ntz, standup_text string, quality_score int",
    )
    attempts = spark.createDataFrame(
        [(3, 1, "weak", 10), (3, 2, "good", 80), (4, 1, "other", 90), (1, 1, "unused", 99)],
        "request_id bigint, attempt bigint, response string, score int",
    ).selectExpr("*", "array() AS issues", "array() AS strengths")
    got = {r.request_id: tuple(r)[2:] for r in outcomes(requests, history, attempts, 60, 0, 1).collect()}
    assert got == {
        1: ("reused", "", "stored", 70),
        2: ("failed", "", None, None),
        3: ("generated", "", "good", 80),
        4: ("limited", "daily", None, None),
        5: ("limited", "invalid", None, None),
    }


def test_a_generated_text_is_recorded_once_with_its_call(spark, tmp_path, monkeypatch):
    """Also when the run is cut off between the two tables, and when it is repeated."""
    history, calls = str(tmp_path / "history"), str(tmp_path / "calls")
    decided = spark.createDataFrame(
        [(1, 7, "reused", "", "stored", 70), (2, 7, "limited", "daily", None, None), (3, 7, "generated", "", "good", 80), (4, None, "generated", "", "text", 60)],
        "request_id bigint, user_id bigint, outcome string, reason string, text string, score int",
    )
    requests = spark.createDataFrame(
        [(i, 5, f"h{i}", "casual", "local", "m", ["api"], 24, DAY.replace(day=i)) for i in range(1, 6)],
        "request_id bigint, user_id bigint, commit_hash string, tone string, provider string, model string, repos array<string>, hours_lookback int, requested_at timestamp_ntz",
    )

    def cut_off(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(outcome, "append_history", cut_off)
        with pytest.raises(RuntimeError, match="lost"):
            record_outcomes(decided, requests, history, calls)
    assert read_calls(spark, calls).count() == 2 and read_history(spark, history).count() == 0
    for _ in range(2):
        record_outcomes(decided, requests, history, calls)
        stored = sorted((r.id, r.commit_hash, r.standup_text, r.quality_score, str(r.created_date)) for r in read_history(spark, history).collect())
        assert stored == [(3, "h3", "good", 80, "2024-01-03"), (4, "h4", "text", 60, "2024-01-04")]
        assert sorted((r.call_id, r.user_id) for r in read_calls(spark, calls).collect()) == [(3, 7), (4, None)]
    record_outcomes(decided.filter("outcome <> 'generated'"), requests, history, calls)
    assert read_calls(spark, calls).count() == 2
