"""Commit operators on small tables."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from daybook.functions import commits as fc
from daybook.operators import commits as oc
from daybook.plans import daily
from daybook.sources.tables import union_repos

TYPES = {
    "feat(auth): add login flow": "feat",
    "fix: patch race condition": "fix",
    "STYLE!: tabs": "style",
    "feat (x): spaced": "unknown",
    "update README with setup notes": "docs",
    "update GitHub Actions pipeline": "ci",
    "Merge branch 'main' into feature": "merge",
    "merged it": "merge",
    "this is work in progress": "wip",
    "rollback": "revert",
    "make it faster": "perf",
    "misc cleanupish maybe": "unknown",
    "éadd nothing": "unknown",
    "add_thing": "unknown",
    "añadir: add": "feat",
    "": "unknown",
    "  ": "unknown",
    None: "unknown",
}
NOISE = {
    "merge remote-tracking branch origin/main": True,
    "fixup! feat: add parser": True,
    "Squash! x": True,
    "WIP sketch": True,
    "wipe data": False,
    "1.2.3": True,
    "1.2.3-rc": False,
    "Update README": True,
    "update readme now": False,
    "initial commit": True,
    "feat: ship cache": False,
    "": True,
    "   ": True,
    None: True,
}
MODULES = {
    "README.md": "README.md",
    "src/app.py": "src",
    "src/auth/login.py": "auth",
    "./src//auth/./login.py": "auth",
    "/etc/app/x": "etc",
    "/etc": "/",
    "/": "/",
    "//host/share/x": "host",
    "a/b/": "a",
    "a/b/.": "a",
    "a/b/c/": "b",
    "": None,
    ".": None,
}
COMMIT = (
    "seq bigint, repo string, hash string, author_email string, committed_at timestamp_ntz, "
    "tz_offset_min int, message string"
)
FILES = "seq bigint, pos int, a_path string, b_path string, insertions bigint, deletions bigint"


def test_types(values_of):
    assert dict(zip(TYPES, values_of(fc.classify, list(TYPES)), strict=True)) == TYPES


def test_noise(values_of):
    assert dict(zip(NOISE, values_of(fc.is_noise, list(NOISE)), strict=True)) == NOISE


def test_modules(values_of):
    assert dict(zip(MODULES, values_of(fc.path_module, list(MODULES)), strict=True)) == MODULES


def _sample(spark):
    at = datetime(2024, 1, 15, 9, 32)
    commits = [
        (1, "my-app", "abc1234ff", "a@x.co", at, 0, "fix login bug"),
        (2, "my-app", "def5678ff", "a@x.co", at.replace(hour=11, minute=15), 0, "refactor token validation"),
        (3, "api-service", "ghi9012ff", "a@x.co", at.replace(hour=14, minute=5), 0, "add /users endpoint"),
    ]
    files = [
        (1, 2, None, "tests/test_auth.py", 2, 2),
        (1, 1, None, "src/auth/login.py", 40, 5),
        (2, 1, "src/auth/tokens.py", "", 18, 33),
        (3, 1, None, "routes/users.py", 90, 1),
        (3, 2, None, "models/user.py", 1, 1),
        (3, 3, "", None, 0, 0),
    ]
    return spark.createDataFrame(commits, COMMIT), spark.createDataFrame(files, FILES)


def test_digest_of_the_sample(spark):
    commits, files = _sample(spark)
    row = daily.author_days(commits, files).first()
    assert row["digest"] == "\n".join(
        [
            "REPO: my-app",
            "- [09:32] \U0001f41b (fix) fix login bug -> files: src/auth/login.py, tests/test_auth.py (+42/-7)",
            "- [11:15] (refactor) refactor token validation -> files: src/auth/tokens.py (+18/-33)",
            "",
            "REPO: api-service",
            "- [14:05] ✨ (feat) add /users endpoint -> files: routes/users.py, models/user.py (+91/-2)",
            "",
            "SUMMARY: 3 commit(s), +151/-42 lines, modules: auth, models, routes, tests",
        ]
    )
    joined = "\n".join(sorted(["abc1234", "def5678", "ghi9012"]))
    assert row["fingerprint"] == hashlib.sha256(joined.encode()).hexdigest()
    assert row["repos"] == ["api-service", "my-app"]


def test_digest_is_the_same_for_any_partitioning(spark):
    commits, files = _sample(spark)
    one = daily.author_days(commits.coalesce(1), files.coalesce(1)).collect()
    many = daily.author_days(commits.repartition(8), files.repartition(8)).collect()
    assert one == many


def test_scan_formats_time_in_the_commits_own_offset(spark):
    commits, files = _sample(spark)
    shifted = commits.withColumn("tz_offset_min", F.lit(-90))
    rows = {r.seq: r for r in oc.scan(shifted, files).collect()}
    assert rows[1].timestamp == "2024-01-15 08:02"
    assert rows[1].hash == "abc1234"
    assert (rows[1].n_files, rows[3].n_files) == (2, 2)
    assert rows[2].modules == ["auth"]
    named = sorted((r.seq, r.pos, r.path) for r in oc.paths(files).collect())
    assert [p for q, _, p in named if q == 1] == ["src/auth/login.py", "tests/test_auth.py"]
    assert [p for q, _, p in named if q == 3] == ["routes/users.py", "models/user.py"]


@pytest.mark.parametrize("n", [3, 25_000])
def test_scan_gives_one_row_per_commit_of_any_size(spark, n):
    commits, _ = _sample(spark)
    files = spark.range(n).selectExpr(
        "1 AS seq", "id AS pos", "CAST(NULL AS STRING) AS a_path", "'d/f' || id AS b_path", "1 AS insertions", "0 AS deletions"
    )
    [row] = oc.scan(commits, files).filter("seq = 1").collect()
    assert (row.n_files, row.insertions, row.modules) == (n, n, ["d"])
    assert oc.paths(files).count() == n


def test_null_authors_and_repositories_are_kept(spark):
    rows = [
        (1, "r", "h1", None, datetime(2024, 1, 1), 0, "wip"),
        (2, "r", "h2", None, datetime(2024, 1, 1), 0, "merge branch x"),
        (3, None, "h3", "a@x", datetime(2024, 1, 1), 0, "feat: one"),
        (4, "r", "h4", "a@x", datetime(2024, 1, 1), 0, "wip"),
    ]
    names = "seq bigint, repo string, hash string, author_email string, committed_at timestamp_ntz, tz_offset_min int, message string"
    commits = spark.createDataFrame(rows, names)
    kept = oc.drop_noise(commits, ["author_email"])
    capped = oc.drop_noise_in_capped_runs(commits, ["author_email"])
    assert sorted(r.seq for r in kept.collect()) == sorted(r.seq for r in capped.collect()) == [1, 2, 3]
    files = spark.createDataFrame([], FILES)
    full = oc.with_file_totals(oc.with_subject(commits), files)
    [digest] = oc.digest(oc.with_lines(oc.annotate(full)), ["author_email"]).filter("author_email = 'a@x'").collect()
    assert digest.commits == 2 and len([x for x in digest.digest.split("\n") if "feat" in x or "wip" in x]) == 2


def test_a_day_across_midnight_is_one_window(spark):
    from daybook.plans import daily

    rows = [
        (1, "r", "h1", "a@x", datetime(2024, 1, 1, 20), 0, "feat: one"),
        (2, "r", "h2", "a@x", datetime(2024, 1, 2, 8), 0, "fix: two"),
    ]
    names = "seq bigint, repo string, hash string, author_email string, committed_at timestamp_ntz, tz_offset_min int, message string"
    commits, files = spark.createDataFrame(rows, names), spark.createDataFrame([], FILES)
    assert daily.author_windows(commits, files, "2024-01-02 09:00:00", 24).count() == 1
    assert daily.author_days(commits, files, "2024-01-02 09:00:00", 24).count() == 2
    [run] = daily.author_windows(commits, files, "2024-01-02 09:00:00", 24).collect()
    stored = spark.createDataFrame(
        [(7, run.fingerprint, "casual", "local", datetime(2024, 1, 2, 7), "text", 80)],
        "id bigint, commit_hash string, tone string, provider string, created_at timestamp_ntz, standup_text string, quality_score int",
    )
    runs = daily.author_windows(commits, files, "2024-01-02 09:00:00", 24)
    again = daily.with_reuse(runs, stored, "casual", "local", requested_at="2024-01-02 09:00:00")
    assert [(r.hit, r.history_id) for r in again.collect()] == [(True, 7)]


@pytest.mark.parametrize("n,want", [(0, ""), (5, "f0, f1, f2, f3, f4"), (10, "f0, f1, f2, f3, f4 (+5 more)")])
def test_files_preview(spark, n, want):
    commits = spark.createDataFrame([(1,)], "seq bigint")
    files = spark.createDataFrame([(1, i, None, f"f{i}", 1, 0) for i in range(n)], FILES)
    out = oc.with_file_totals(commits, files)
    got = out.select(fc.files_preview("first_paths", "n_files").alias("p"), "n_files").first()
    assert (got["p"], got["n_files"]) == (want, n)


def test_noise_only_run_keeps_everything(spark):
    rows = [(1, "a", "wip"), (1, "a", "fix: x"), (2, "b", "wip"), (2, "b", " ")]
    df = spark.createDataFrame(rows, "run int, repo string, message string")
    for rule in (oc.drop_noise, oc.drop_noise_in_capped_runs):
        got = sorted((r.run, r.message) for r in rule(df, ["run"]).collect())
        assert got == [(1, "fix: x"), (2, " "), (2, "wip")]


def test_strict_walk_stops_where_the_default_goes_on(spark):
    # the default keeps a young commit behind an old one; the strict walk loses it
    rows = [("r", 1, datetime(2024, 1, 3)), ("r", 2, datetime(2024, 1, 1)), ("r", 3, datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "repo string, seq int, committed_at timestamp_ntz")
    now = "2024-01-03 12:00:00"
    assert [r.seq for r in oc.lookback(df, now, 24).collect()] == [1, 3]
    assert [r.seq for r in oc.lookback_strict_walk(df, now, 24).collect()] == [1]


def test_cap_and_its_flag(spark):
    rows = [("big", i, datetime(2024, 1, 1, i // 60, i % 60)) for i in range(205)]
    rows += [("small", 1, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "repo string, seq int, committed_at timestamp_ntz")
    out = oc.cap_newest(df).collect()
    big = [r for r in out if r.repo == "big"]
    assert len(big) == 200 and min(r.seq for r in big) == 5 and all(r.truncated for r in big)
    assert [r.truncated for r in out if r.repo == "small"] == [False]


def test_author_filter(spark):
    df = spark.createDataFrame([("a@x",), ("A@x",)], "author_email string")
    assert oc.by_author(df, "a@x").count() == 1
    assert oc.by_author(df, "").count() == 2
    assert oc.by_author(df, df.limit(0)).count() == 2
    assert oc.by_author(df, df.filter("author_email = 'A@x'")).collect()[0][0] == "A@x"


def test_given_types_win_in_the_summary(spark):
    df = spark.createDataFrame([("docs", "fix: x"), ("", "fix: x"), (None, "wip")], "type string, message string")
    assert {r["type"]: r.n for r in oc.count_by_type(df).collect()} == {"docs": 1, "fix": 1, "wip": 1}


def test_fingerprint_ignores_order_and_keeps_repeats(spark):
    def print_of(hashes):
        df = spark.createDataFrame([(1, h) for h in hashes], "run int, hash string")
        return oc.fingerprint(df, ["run"]).first()["fingerprint"]

    assert print_of(["b", "a"]) == print_of(["a", " b "]) != print_of(["a", "a", "b"])
    assert print_of([" "]) == hashlib.sha256(b"").hexdigest()


def test_totals_of_a_run_without_modules(spark):
    df = spark.createDataFrame(
        [(1, 2, 1, []), (1, 3, None, ["a", "b"]), (2, None, None, [])],
        "run int, insertions int, deletions int, modules array<string>",
    )
    got = {r.run: r for r in oc.totals(df, ["run"]).collect()}
    assert (got[1].commits, got[1].insertions, got[1].deletions, got[1].modules) == (2, 5, 1, ["a", "b"])
    assert (got[2].commits, got[2].insertions, got[2].modules) == (1, 0, [])


def test_union_of_repositories(spark):
    a = spark.createDataFrame([(1, "x")], "seq int, repo string")
    b = spark.createDataFrame([("y", 2)], "repo string, seq int")
    assert sorted(map(tuple, union_repos([a, b]).collect())) == [(1, "x"), (2, "y")]


def test_prompts(spark):
    df = spark.createDataFrame([("D", "casual", ["a", "b"]), ("D", "x", [])], "d string, t string, i array<string>")
    rows = df.select(fc.prompt_text("d", "t").alias("p"), fc.retry_prompt("d", "i").alias("r")).collect()
    assert "casual, friendly" in rows[0].p and "formal, professional" in rows[1].p
    assert rows[0].r.startswith("Please revise") and "- a\n- b\n\nOriginal request:\nD" in rows[0].r
    assert "- Improve specificity" in rows[1].r


def test_cap_limits_rows_before_the_shuffle(spark):
    commits, _ = _sample(spark)
    plan = oc.cap_newest(commits)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
