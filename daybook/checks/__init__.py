"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "commit_checks",
    "text_checks",
    "history_checks",
    "usage_checks",
    "log_checks",
    "answer_checks",
    "outcome_checks",
    "settings_checks",
)


def all_queries() -> tuple[dict, dict]:
    """Registered queries and oracles by name."""
    for name in MODULES:
        import_module(f"daybook.checks.{name}")
    from daybook.checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
