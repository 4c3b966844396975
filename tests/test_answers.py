"""Scores, attempts, sections, templates, logs and settings."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from daybook.functions import scores
from daybook.functions import settings as fs
from daybook.functions import templating as ft
from daybook.operators import attempts as oa
from daybook.operators import health, logs, settings
from daybook.plans import maintenance
from daybook.operators import templates as ot
from daybook.sources import loglines

EMPTY = (0, [], [])
PAYLOADS = [
    ('{"score": 88, "issues": ["vague"], "strengths": ["clear"]}', (88, ["vague"], ["clear"])),
    ('```json\n{"score": 75, "issues": [], "strengths": ["good"]}\n```', (75, [], ["good"])),
    ("not json", EMPTY),
    ("{invalid}", EMPTY),
    ("", EMPTY),
    (None, EMPTY),
    ('{"score": -10}', EMPTY),
    ('{"score": 150}', (100, [], [])),
    ('{"score": null, "issues": ["a"]}', (0, ["a"], [])),
    ('{"score": "bad"}', EMPTY),
    ('{"score": "85"}', (85, [], [])),
    ('{"score": 85.7}', (85, [], [])),
    ('{"score": "85.5"}', EMPTY),
    ('{"score": true}', (1, [], [])),
    ('{"score": [1]}', EMPTY),
    ('{"score": 80, "issues": "single", "strengths": {"k": "v"}}', (80, [], [])),
    ('{"score": 5, "issues": ["a", " ", 3, true, null]}', (5, ["a", "3", "True", "None"], [])),
    ('{"score": 5} and {x}', EMPTY),
    ('{"score": 1, "score": 2}', (2, [], [])),
    ('{"score": NaN, "issues": ["a"]}', (0, ["a"], [])),
    ('{"score": Infinity, "issues": ["a"]}', EMPTY),
    ("{'score': 9}", EMPTY),
]


def test_score_payloads(values_of):
    got = values_of(scores.score_payload, [p for p, _ in PAYLOADS])
    assert [(g["score"], g["issues"], g["strengths"]) for g in got] == [w for _, w in PAYLOADS]


def test_score_bands(spark):
    df = spark.createDataFrame([(n,) for n in (100, 80, 79, 60, 59, 0)], "s int")
    got = [r[0] for r in df.select(scores.score_band("s")).collect()]
    assert got == ["HIGH", "HIGH", "OK", "OK", "LOW", "LOW"]


@pytest.mark.parametrize(
    "given,want", [([90], ("d1", 0)), ([40, 85], ("d2", 1)), ([10, 10, 10], ("d3", 2)),
                   ([10, 10, 10, 99], ("d3", 2)), ([85, 90], ("d1", 0))],
)
def test_attempts(spark, given, want):
    rows = [(1, i + 1, f"d{i + 1}", json.dumps({"score": s})) for i, s in enumerate(given)]
    df = spark.createDataFrame(rows, "run_id int, attempt int, response string, raw string")
    got = oa.choose(oa.with_scores(df), 80).first()
    assert (got.response, got.retries) == want


SECTIONS = [
    ("**Yesterday:** moved the parser\n**Today:** measure it\n**Blockers:** no disk", ("moved the parser", "measure it", "no disk")),
    ("## Yesterday\nRead logs\n## Today\nCut the index\n## Blockers\nSlow network", None),
    ("[Yesterday] merged\n[Today] tags\n[Impediments] no keys", None),
    ("All quiet here, nothing under a title.", ("All quiet here, nothing under a title.", "", "None")),
    ("***", ("", "", "None")),
    ("", ("", "", "None")),
    (None, ("", "", "None")),
    ("Yesterday: a\r\nline two\nToday: b\n", ("a\r\nline two", "b", "None")),
    ("x" * 600, ("x" * 500, "", "None")),
]


def test_sections(values_of):
    got = values_of(ft.sections, [t for t, _ in SECTIONS])
    for row, (_, want) in zip(got, SECTIONS, strict=True):
        if want:
            assert tuple(row) == want
    assert "Read logs" in got[1].yesterday and "Cut the index" in got[1].today
    assert "Slow network" in got[1].blockers and got[2].blockers == "no keys"


def test_render(spark):
    big = "x" * 5010
    rows = [
        ("Done: {yesterday} {mystery}", {"yesterday": "cache"}),
        ("{yesterday}{today}", {"yesterday": "{today}", "today": "{yesterday}"}),
        ("Done: {yesterday}", {"yesterday": big}),
        ("{yesterday}{today}{blockers}", {"yesterday": big, "today": big, "blockers": big}),
        ("{__import__('os')}{today}", {"x": "y"}),
        (None, {"x": "y"}),
        ("{YESTERDAY}{{today}}", {"today": "t"}),
    ]
    df = spark.createDataFrame(rows, "b string, v map<string,string>")
    got = [r[0] for r in df.select(ft.render("b", "v")).collect()]
    assert got[0] == "Done: cache {mystery}"
    assert got[1] == "{today}{yesterday}"
    assert len(got[2]) == len("Done: ") + 5000 and len(got[3]) == 10000
    assert got[4] == "{__import__('os')}" and got[5] == "" and got[6] == "{YESTERDAY}{t}"


TEMPLATES = {
    "Done: {yesterday}": "",
    "": "empty",
    " \t": "empty",
    "{yesterday}" + "x" * 2100: "2000",
    "{{yesterday}}": "nested",
    "Done: {yesterday!r}": "format",
    "Done: {yesterday:>10}": "format",
    "Done: {yesterday.x}": "format",
    "plain": "placeholder",
    "{mystery}{alpha}{today}": "alpha, mystery",
    None: "string",
}


def test_template_rules(values_of):
    for got, want in zip(values_of(ft.template_error, list(TEMPLATES)), TEMPLATES.values(), strict=True):
        assert (want in got) if want else got == ""


def test_template_lookup(spark):
    custom = spark.createDataFrame(
        [("team", "Done: {yesterday}"), ("bad", "{yesterday!r}"), ("slack", "mine {today}")], "name string, body string"
    )
    wanted = spark.createDataFrame([(n,) for n in ("team", "bad", "slack", "jira", "gone")], "template string")
    got = {r.template: r for r in ot.look_up(wanted, custom).collect()}
    assert got["team"].body == "Done: {yesterday}" and got["team"].status == "ok"
    assert got["bad"].status == "invalid" and got["bad"].body is None and "format" in got["bad"].problem
    assert got["slack"].body == "mine {today}"
    assert got["jira"].status == "ok" and got["gone"].status == "missing"
    assert "the digest job" in ot.builtin_bodies()["slack"]


def _lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "seq int, line string")


def test_log_tail_takes_lines_first(spark):
    lines = _lines(spark, ['{"event": "lost"}', '{"event": "good"}', "not json", "[1]", '{"event": "also good"}'])
    assert [r.seq for r in logs.tail(lines, 4).collect()] == [1, 4]
    assert [r.seq for r in logs.tail(lines, 0).collect()] == [4]


def test_log_redaction(spark):
    cases = [
        ({"api_key": "a", "provider": "x", "Commit_Message": "m"}, {"api_key": "[REDACTED]", "provider": "x", "Commit_Message": "[REDACTED]"}),
        ({"details": {"commit_message": "fix", "count": 5}}, {"details": {"commit_message": "[REDACTED]", "count": 5}}),
        ({"tags": ["a", "b"], "n": 1.5, "t": True, "z": None}, {"tags": ["a", "b"], "n": 1.5, "t": True, "z": None}),
        ({"repos": {"token": "kept under a safe key"}}, {"repos": {"token": "kept under a safe key"}}),
        ({"items": [{"token": "x", "n": 1}]}, {"items": [{"token": "[REDACTED]", "n": 1}]}),
        ({"note": "brace { inside"}, {"note": "brace { inside"}),
        ({"ünïcode": "é"}, {"ünïcode": "é"}),
    ]
    lines = _lines(spark, [json.dumps(given) for given, _ in cases] + ["not json", "[]"])
    got = [json.loads(r.line) for r in logs.redact(lines).orderBy("seq").collect()]
    assert got == [want for _, want in cases]


def test_log_view(spark):
    line = {"ts": "2024-01-02T03:04:05", "event": "e", "level": "INFO", "b": [1, "x", True, None], "a": False, "n": None, "s": "t"}
    row = logs.view(_lines(spark, [json.dumps(line)])).first()
    assert (row.time, row.event) == ("03:04:05", "e")
    assert row.detail == "a=False, b=[1, 'x', True, None], n=None, s=t"


def test_log_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 2, 3, 4, 5), "done", 3, "s3cr3t", None)],
        "ts timestamp_ntz, event string, commit_count int, password string, note string",
    )
    encoded = logs.encode(rows, "event", fields=["commit_count", "password", "note"])
    path = str(tmp_path / "log")
    loglines.write_lines(encoded, path)
    back = loglines.read_lines(spark, path)
    assert json.loads(back.first()["line"]) == {
        "ts": "2024-01-02T03:04:05", "level": "INFO", "event": "done",
        "commit_count": 3, "password": "[REDACTED]", "note": None,
    }
    assert logs.tail(back, 5).count() == 1


GOOD = {
    "repos": ["/srv/a"], "author_email": "", "hours_lookback": 24, "tone": "casual",
    "slack_webhook_url": "", "template": "default", "custom_templates": {},
    "provider": {"name": "ollama", "ollama": {"base_url": "http://localhost:11434", "model": "m"},
                 "groq": {"api_key": "", "model": "g"}},
    "rate_limit": {"cooldown_minutes": 30, "max_calls_per_day": 10, "enabled": True},
    "quality": {"enabled": True, "min_score": 0, "show_breakdown": False},
    "noise_filter_enabled": True, "auto_warm_up": False,
}
BROKEN = [
    ({}, []),
    ({"author_email": "bad"}, ["author_email: Invalid email format: 'bad'"]),
    ({"author_email": None}, ["author_email: Invalid email format: None"]),
    ({"hours_lookback": 721}, ["hours_lookback: hours_lookback must be between 1 and 720, got: 721",
                               "hours_lookback must be between 1 and 720, got: 721"]),
    ({"hours_lookback": "x"}, ["hours_lookback: hours_lookback must be an integer, got: 'x'",
                               "hours_lookback must be an integer, got: 'x'"]),
    ({"hours_lookback": "24"}, []),
    ({"hours_lookback": 24.9}, []),
    ({"tone": " CASUAL "}, []),
    ({"tone": 5}, ["tone: tone must be a string, got: int"]),
    ({"tone": "angry"}, ["tone: tone must be one of ('casual', 'formal'), got: 'angry'"]),
    ({"slack_webhook_url": "http://x"}, ["slack_webhook_url: slack_webhook_url must start with 'https://hooks.slack.com/', got: 'http://x'"]),
    ({"repos": "x"}, ["repos must be a JSON array."]),
    ({"repos": ["a", "", 3]}, ["repos: each entry must be a non-empty string."] * 2),
    ({"repos": ["r"] * 21}, ["repos must contain at most 20 entries."]),
    ({"provider": {"name": "x"}}, ["provider: provider.name must be one of ('ollama', 'groq'), got: 'x'"]),
    ({"provider": []}, ["provider: provider must be a JSON object."]),
    ({"rate_limit": {"enabled": "yes", "cooldown_minutes": 0, "max_calls_per_day": 0}},
     ["rate_limit: rate_limit.enabled must be a boolean. | rate_limit.max_calls_per_day must be between 1 and 50."]),
    ({"rate_limit": {"enabled": True, "cooldown_minutes": None, "max_calls_per_day": 5}}, []),
    ({"quality": {"enabled": True, "show_breakdown": False, "min_score": 101}},
     ["quality: quality.min_score must be between 0 and 100."]),
    ({"quality": 1}, ["quality: quality must be a JSON object."]),
    ({"template": "lost"}, ["template: template must be one of ['default', 'detailed', 'jira', 'minimal', 'slack'], got: 'lost'"]),
    ({"template": "team", "custom_templates": {"team": "{today}"}}, []),
    ({"custom_templates": {"bad name": "{today}", "ok": "plain"}},
     ["custom_templates: custom_templates keys must use letters, numbers, underscores, or dashes (max 50 chars). | "
      "custom_templates.ok: Template must contain at least one valid {variable} placeholder."]),
    ({"custom_templates": {f"t{i}": "{today}" for i in range(11)}},
     ["custom_templates: custom_templates must contain at most 10 templates.",
      "custom_templates must contain at most 10 entries."]),
    ({"noise_filter_enabled": 1}, ["noise_filter_enabled must be a boolean."]),
    ({"auto_warm_up": None}, ["auto_warm_up must be a boolean."]),
]


def test_settings_rules(spark):
    rows = [(i, json.dumps({**GOOD, **change})) for i, (change, _) in enumerate(BROKEN)]
    rows.append((len(BROKEN), "[1]"))
    df = settings.validate(spark.createDataFrame(rows, "scope int, settings string"))
    got = {r.scope: r for r in df.collect()}
    for i, (_, want) in enumerate(BROKEN):
        assert got[i].errors == want
        assert got[i].is_valid == (not want)
    assert got[len(BROKEN)].errors == ["settings must be a JSON object."]
    good, bad = settings.split_valid(df)
    assert good.count() + bad.count() == len(rows)


def test_provider_messages(spark):
    block = {"name": "groq", "ollama": {"base_url": "ftp://x", "model": " "}, "groq": {"model": "g", "api_key": "abc"}}
    df = spark.createDataFrame([(json.dumps({**GOOD, "provider": block}),)], "settings string")
    assert settings.validate(df).first()["errors"] == [
        "provider: provider.ollama.base_url must be a valid URL, got: 'ftp://x' | "
        "provider.ollama.model must be a non-empty string. | "
        "provider.groq.api_key must start with 'gsk_' when provided."
    ]


def test_settings_of_one_split_are_judged_in_many_tasks(spark):
    one = spark.range(0, 400, 1, 1).select("id", F.lit(json.dumps({**GOOD, "tone": 5})).alias("settings"))
    judged = settings.validate(one)
    tasks = judged.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if(~F.col("is_valid")).alias("n")).collect()
    assert len(tasks) >= 4 and sum(r.n for r in tasks) == 400 and max(r.n for r in tasks) <= 200
    assert settings.validate(one, tasks=0).select(F.spark_partition_id()).distinct().count() == 1
    assert sorted(judged.collect()) == sorted(settings.validate(one, tasks=0).collect())


def test_blocks_of_another_type(spark):
    rows = [(i, json.dumps({**GOOD, **change})) for i, change in enumerate((
        {"provider": {"name": "groq", "ollama": [1], "groq": None}},
        {"rate_limit": ["enabled"]}, {"quality": None}, {"custom_templates": [1]}, {"repos": {"a": 1}},
    ))]
    got = {r.scope: r.errors for r in settings.validate(spark.createDataFrame(rows, "scope int, settings string")).collect()}
    assert got == {
        0: ["provider: provider.ollama must be a JSON object. | provider.groq must be a JSON object."],
        1: ["rate_limit: rate_limit must be a JSON object."],
        2: ["quality: quality must be a JSON object."],
        3: ["custom_templates: custom_templates must be a JSON object."],
        4: ["repos must be a JSON array."],
    }


def test_rules_fit_methods_that_hotspot_compiles(spark):
    number = F.col("id").cast("string")
    text = F.concat(F.lit(json.dumps(GOOD)[:-1] + ', "other": '), number, F.lit("}"))  # no constant
    documents = spark.range(40).select(text.alias("settings"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the final plan without a run
    try:
        counted = settings.validate(documents).agg(F.count_if("is_valid"))
        plan = counted._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert 0 < max(sizes) < 8000  # longer methods stay interpreted, at every row


def test_entries_and_templates_in_doubt(spark):
    bad = "repos: each entry must be a non-empty string."
    repos = [
        (["/a", "b,c", ",", "[x", 'q"', "é", "a\\b", "\u200b"], 0), (["\u00a0"], 1), (["a", "\x1f"], 1), (["a", None], 1),
        (["a", [""]], 1), ([["a"]], 1), (["a", {"b": "c"}], 1), ([1, True, "a", "\u3000"], 3), ([], 0), (["", ""], 2),
    ]
    bodies = [
        "{today}{date}", "{today}}", "{{today}", "{today} {x}", "{today", "}{today}", "{today:>3}", "{Today}", "a{provider}b",
        "{today}" + "x" * 1993, "{today}" + "x" * 1994, " ", "", "plain", "{tod{today}ay}", "{{today}}", "\u00a0{time}\n",
    ]
    rows = [(i, json.dumps({**GOOD, "repos": r})) for i, (r, _) in enumerate(repos)]
    rows += [(len(repos) + i, json.dumps({**GOOD, "custom_templates": {"t": b}})) for i, b in enumerate(bodies)]
    got = {r.scope: r.errors for r in settings.validate(spark.createDataFrame(rows, "scope int, settings string")).collect()}
    assert [got[i] for i in range(len(repos))] == [[bad] * n for _, n in repos]
    told = [got[len(repos) + i] for i in range(len(bodies))]
    problems = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", ft.template_error("b").alias("p")).collect()
    assert told == [[f"custom_templates: custom_templates.t: {r.p}"] if r.p else [] for r in sorted(problems)]
    assert [i for i, e in enumerate(told) if not e] == [0, 5, 8, 9, 14, 16]


def test_layered_settings(spark):
    rows = [
        ("tone", "casual", 0), ("rate.cooldown", "30", 0), ("rate.cap", "10", 0), ("key", "", 0),
        ("tone", None, 1), ("rate.cap", "5", 1), ("key", "file", 1), ("key", "", 2), ("key", "env", 3),
        ("a.b", "1", 0), ("a.c", "2", 0), ("a", "off", 1), ("a.b", "3", 2),
        ("d", "plain", 0), ("d.e", "block", 1),
    ]
    rows = [("s", *r) for r in rows]
    df = spark.createDataFrame(rows, "scope string, key string, value string, layer int")
    got = {r.key: r.value for r in settings.resolve(df).collect()}
    assert got == {
        "tone": None, "rate.cooldown": "30", "rate.cap": "5", "key": "env", "a.b": "3", "d.e": "block",
    }


def test_arguments(value_of):
    def errors(hours, week, command, clear, limit):
        c = fs.argument_errors(*(F.lit(x) for x in (hours, week, command, clear, limit)))
        return len(value_of(c))

    assert errors(5, True, "run", False, None) == 1
    assert errors(0, True, "run", False, None) == 0
    assert errors(None, False, "history", True, 10) == 0
    assert errors(None, False, "history", True, 5) == 1
    for text, want in [("5", ""), ("0", "between"), ("x", "integer"), ("201", "between")]:
        got = value_of(fs.bounded_int_error(F.lit(text), "--tail"))
        assert want in got if want else got == ""


def test_health_score(spark):
    rows = [("a", "pass"), ("a", "warn"), ("a", "info"), ("b", "fail"), ("c", "pass")]
    df = spark.createDataFrame(rows, "scope string, status string")
    got = {r.scope: (r.score, r.band) for r in health.score(df, ["scope"]).collect()}
    assert got == {"a": (66, "fair"), "b": (0, "low"), "c": (100, "good")}
    assert health.score(df.limit(0)).first()["score"] == 0


def test_table_health_judges_one_split_in_many_tasks(spark):
    documents = spark.range(0, 40, 1, 1).select(F.lit(json.dumps({**GOOD, "tone": 5})).alias("settings"))
    history = spark.createDataFrame([("text",)], "standup_text string")
    versions = spark.createDataFrame([(50,)], "version int")
    keys = spark.createDataFrame([("",)], "key string")
    checks = maintenance.table_health(history, versions, documents, keys, latest=50)
    got = {r.check: (r.status, r.detail) for r in checks.collect()}
    assert got["Settings valid"] == ("fail", "40 of 40 invalid")
    assert "RoundRobinPartitioning(8)" in checks._jdf.queryExecution().executedPlan().toString()
