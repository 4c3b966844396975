"""Run queries beside their oracles and compare the rows.

``python -m daybook.checks.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from daybook.checks import all_queries
from daybook.session import build

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "" if value != value else repr(round(value, 9))
    return "" if value is None or value is pd.NaT else str(value)


def rows_of(frame) -> list[tuple]:
    """Rows as texts with columns by name, sorted."""
    names = sorted(frame.column_names)
    columns = [[_cell(v) for v in frame.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True))


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, str]:
    """Verdict and detail for one query."""
    queries, oracles = all_queries()
    started = time.perf_counter()
    got = queries[name](spark, sf_dir).toArrow()
    spent = time.perf_counter() - started
    if name not in oracles:
        return "rows-only", f"{got.num_rows} rows, {spent:.2f}s"
    want = con.execute(oracles[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return "columns", f"{got.column_names} / {want.column_names}"
    types = [
        f"{n}: {got.schema.field(n).type} / {want.schema.field(n).type}"
        for n in got.column_names
        if str(got.schema.field(n).type).replace("large_", "")
        != str(want.schema.field(n).type).replace("large_", "")
    ]
    left, right = rows_of(got), rows_of(want)
    if left != right:
        only_left = sorted(set(left) - set(right))[:2]
        only_right = sorted(set(right) - set(left))[:2]
        return "DIFFERENT", f"{len(left)}/{len(right)} rows\n  spark {only_left}\n  sql   {only_right}"
    note = f" types {types}" if types else ""
    return "same", f"{len(left)} rows, {spent:.2f}s{note}"


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in args[1:] or all_queries()[0]:
        try:
            verdict, detail = compare(spark, con, name, sf_dir)
        except Exception as problem:  # noqa: BLE001
            verdict, detail = "FAILED", str(problem)[:1500]
        bad += verdict not in ("same", "rows-only")
        print(f"{verdict:10} {name:24} {detail}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
