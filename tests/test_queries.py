"""Every registered query against its SQL on the smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from daybook.checks import all_queries
from daybook.checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()[0]))
def test_query_equals_sql(spark, con, name):
    verdict, detail = compare(spark, con, name, SF_DIR)
    assert verdict == "same", detail


def test_every_query_has_an_oracle():
    own, oracles = all_queries()
    assert set(own) == set(oracles)
    assert set(own) <= set(contract.queries()) and set(oracles) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_patterns_live_in_one_place():
    """Regular expressions with secrets or word lists appear only among the fixed values."""
    for path in (ROOT / "daybook").rglob("*.py"):
        if path.name == "rules.py" or {"checks", "llm"} & set(path.parts):
            continue
        text = path.read_text(encoding="utf-8")
        assert not re.search(r"AKIA|github_pat|password\|", text), path


def test_operators_never_collect():
    """Operators build plans; nothing is pulled to the driver or kept on one machine."""
    for folder in ("functions", "operators", "plans", "streaming", "sources"):
        for path in (ROOT / "daybook" / folder).rglob("*.py"):
            text = path.read_text(encoding="utf-8")
            assert not re.search(
                r"\.collect\(\)|toPandas|localCheckpoint|crossJoin|\.rdd\b|toLocalIterator", text
            ), path
