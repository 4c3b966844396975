"""Queries over generated answers: scores, attempts, sections, templates, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.checks.fixtures import with_inputs
from daybook.checks.registry import query
from daybook.functions import commits as fc
from daybook.functions import scores
from daybook.functions import templating as ft
from daybook.operators import attempts as oa
from daybook.operators import templates as ot

_SCORED = """SELECT *, CASE WHEN j = '' THEN 0 ELSE greatest(0, least(100,
    CAST(trunc(CAST(json_extract_string(j, '$.score') AS DOUBLE)) AS INTEGER))) END AS score,
  CASE WHEN j <> '' AND json_type(j, '$.issues') = 'ARRAY' THEN
    list_filter(json_extract_string(j, '$.issues[*]'), lambda x: trim(x) <> '') ELSE [] END AS issues,
  CASE WHEN j <> '' AND json_type(j, '$.strengths') = 'ARRAY' THEN
    list_filter(json_extract_string(j, '$.strengths[*]'), lambda x: trim(x) <> '')
    ELSE [] END AS strengths
FROM (SELECT * EXCLUDE (x), CASE WHEN json_valid(x) THEN x ELSE '' END AS j FROM (
  SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}') AS x FROM {table}))"""


@query(
    "score_payload",
    "answers",
    oracle=with_inputs(
        "answers",
        tables={"s": _SCORED.format(table="answers")},
        then="""SELECT answer_id, score, array_to_string(issues, '|') AS issues,
  array_to_string(strengths, '|') AS strengths FROM s""",
    ),
)
def score_payload(answers):
    return oa.with_scores(answers).select(
        "answer_id",
        "score",
        F.array_join("issues", "|").alias("issues"),
        F.array_join("strengths", "|").alias("strengths"),
    )


@query(
    "score_band",
    "events",
    oracle="""SELECT event_id, CASE WHEN s >= 80 THEN 'HIGH' WHEN s >= 60 THEN 'OK' ELSE 'LOW' END AS band
FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS s FROM events)""",
)
def score_band(events):
    score = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select("event_id", scores.score_band(score).alias("band"))


@query(
    "attempt_select",
    "attempts",
    oracle=with_inputs(
        "attempts",
        tables={
            "s": _SCORED.format(table="attempts"),
            "good": """SELECT run_id, min(attempt) AS n FROM s
  WHERE score >= 60 AND attempt <= 3 GROUP BY run_id""",
            "last": "SELECT run_id, max(attempt) AS n FROM s WHERE attempt <= 3 GROUP BY run_id",
        },
        then="""SELECT s.run_id, s.response, s.score, array_to_string(s.issues, '|') AS issues,
  CAST(s.attempt - 1 AS INTEGER) AS retries
FROM s JOIN last l ON l.run_id = s.run_id LEFT JOIN good g ON g.run_id = s.run_id
WHERE s.attempt = coalesce(g.n, l.n)""",
    ),
)
def attempt_select(attempts):
    return oa.choose(oa.with_scores(attempts), 60).select(
        "run_id", "response", "score", F.array_join("issues", "|").alias("issues"), "retries"
    )


@query(
    "retry_prompt",
    "answers",
    oracle=with_inputs(
        "answers",
        tables={"s": _SCORED.format(table="answers")},
        then="""SELECT answer_id, 'Please revise the standup so it fixes these quality issues:' || chr(10)
  || CASE WHEN len(issues) > 0 THEN '- ' || array_to_string(issues, chr(10) || '- ')
       ELSE '- Improve specificity, completeness, clarity, and actionability.' END
  || chr(10) || chr(10) || 'Original request:' || chr(10) || 'write ' || answer_id AS prompt FROM s""",
    ),
)
def retry_prompt(answers):
    first = F.concat(F.lit("write "), F.col("answer_id").cast("string"))
    return oa.with_scores(answers).select(
        "answer_id", fc.retry_prompt(first, "issues").alias("prompt")
    )


@query(
    "section_extract",
    "section_texts",
    oracle=with_inputs(
        "section_texts",
        then="SELECT text_id, y AS yesterday, t AS today, b AS blockers FROM section_texts",
    ),
)
def section_extract(texts):
    return texts.select("text_id", ft.sections("text").alias("s")).select("text_id", "s.*")


_NOW = "2024-01-31 09:05:00"


def _variables(texts):
    repos = F.expr("slice(array('api', 'ops', 'web'), 1, CAST(text_id % 4 AS INT))")
    return texts.select(
        "text_id",
        ft.template_variables(
            ft.sections("text"),
            F.lit(_NOW).cast("timestamp_ntz"),
            F.col("text_id") % 7,
            repos,
            F.lit("local"),
            F.concat(F.lit("u"), F.col("text_id").cast("string"), F.lit("@example.com")),
        ).alias("v"),
    )


_REPOS = """CASE text_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'api' WHEN 2 THEN 'api, ops'
  ELSE 'api, ops, web' END"""
_NAMES = (
    "yesterday today blockers date time commit_count repos provider author_email".split()
)
_VALUES = f"""SELECT text_id, y AS yesterday, t AS today, b AS blockers, '2024-01-31' AS date,
  '09:05' AS time, CAST(text_id % 7 AS STRING) AS commit_count, {_REPOS} AS repos,
  'local' AS provider, 'u' || text_id || '@example.com' AS author_email FROM section_texts"""


@query("template_vars", "section_texts", oracle=with_inputs("section_texts", then=_VALUES))
def template_vars(texts):
    return _variables(texts).select("text_id", *[F.col("v")[n].alias(n) for n in _NAMES])


def _render_sql(body: str) -> str:
    """Single pass in two: tokens to marks first, then marks to values."""
    for i, name in enumerate(_NAMES):
        body = f"replace({body}, '{{{name}}}', chr({i + 1}))"
    for i, name in enumerate(_NAMES):
        body = f"replace({body}, chr({i + 1}), left({name}, 5000))"
    return f"left({body}, 10000)"


@query(
    "template_render",
    "section_texts",
    "templates",
    oracle=with_inputs(
        "section_texts",
        "templates",
        tables={
            "v": _VALUES.replace("y AS yesterday", "y || ' {today}' AS yesterday"),
        },
        then=f"""SELECT text_id, {_render_sql('body')} AS output
FROM v JOIN templates ON scope = text_id""",
    ),
)
def template_render(texts, templates):
    # a value that looks like a token must come out as it is
    tricky = F.map_concat(
        F.map_filter("v", lambda k, _: k != "yesterday"),
        F.create_map(F.lit("yesterday"), F.concat(F.col("v")["yesterday"], F.lit(" {today}"))),
    )
    filled = _variables(texts).select("text_id", tricky.alias("v"))
    return filled.join(templates, F.col("scope") == F.col("text_id")).select(
        "text_id", ft.render("body", "v").alias("output")
    )


_ERROR = r"""CASE WHEN trim(body) = '' THEN 'Template must not be empty.'
  WHEN length(body) > 2000 THEN 'Template must be 2000 characters or fewer.'
  WHEN contains(body, '{{') OR contains(body, '}}') THEN 'Template must not contain nested braces.'
  WHEN regexp_matches(body, '\{[^{}]*[!:.][^{}]*\}') THEN
    'Template must not use Python format specifiers or attribute access.'
  WHEN NOT regexp_matches(body, '\{[a-z_][a-z0-9_]*\}') THEN
    'Template must contain at least one valid {variable} placeholder.'
  WHEN contains(body, '{mystery}') THEN 'Template contains unsupported variables: alpha, mystery'
  ELSE '' END"""


@query(
    "template_validate",
    "templates",
    oracle=with_inputs(
        "templates", then=f"SELECT scope, name, {_ERROR} AS problem FROM templates"
    ),
)
def template_validate(templates):
    return templates.select("scope", "name", ft.template_error("body").alias("problem"))


@query(
    "template_bad_vars",
    "templates",
    oracle=with_inputs(
        "templates",
        then=r"""SELECT scope, array_to_string(list_sort(list_distinct(list_filter(
    regexp_extract_all(body, '\{([a-z_][a-z0-9_]*)\}', 1), lambda x: x NOT IN ('yesterday', 'today',
    'blockers', 'date', 'time', 'commit_count', 'repos', 'provider', 'author_email')))), ',') AS bad
FROM templates""",
    ),
)
def template_bad_vars(templates):
    return templates.select(
        "scope", F.array_join(ft.unsupported_variables("body"), ",").alias("bad")
    )


@query(
    "template_names",
    "templates",
    oracle=with_inputs(
        "templates",
        then="""SELECT name, CASE WHEN bool_or(own) THEN 'Custom' ELSE 'Built-in' END AS kind FROM (
  SELECT name, true AS own FROM templates
  UNION ALL SELECT unnest(['default', 'slack', 'minimal', 'detailed', 'jira']), false) GROUP BY name""",
    ),
)
def template_names(templates):
    return ot.names(templates)


_BUILTIN_SQL = """CASE {name}
  WHEN 'default' THEN '**Yesterday:** {{yesterday}}' || chr(10) || chr(10) || '**Today:** {{today}}'
    || chr(10) || chr(10) || '**Blockers:** {{blockers}}'
  WHEN 'minimal' THEN '{{yesterday}} | {{today}} | {{blockers}}'
  WHEN 'jira' THEN '[Standup {{date}}]' || chr(10) || 'Done: {{yesterday}}' || chr(10)
    || 'Doing: {{today}}' || chr(10) || 'Impediments: {{blockers}}' END"""
_FOUND = f"""SELECT r.*, CASE WHEN t.name IS NULL THEN {_BUILTIN_SQL.format(name='r.template')}
    WHEN problem = '' THEN t.body END AS body,
  CASE WHEN problem = '' THEN 'ok' WHEN problem <> '' THEN 'invalid'
    WHEN r.template IN ('default', 'minimal', 'jira') THEN 'ok' ELSE 'missing' END AS status,
  coalesce(problem, '') AS problem
FROM r LEFT JOIN t ON t.scope = r.scope AND t.name = r.template"""


@query(
    "template_lookup",
    "template_requests",
    "templates",
    oracle=with_inputs(
        "template_requests",
        "templates",
        tables={
            "t": f"SELECT *, {_ERROR} AS problem FROM templates",
            "r": "SELECT * FROM template_requests",
            "f": _FOUND,
        },
        then="""SELECT l_orderkey, l_linenumber, scope, l_suppkey, template, body, status, problem
FROM f""",
    ),
)
def template_lookup(requests, templates):
    return ot.look_up(requests, templates, ["scope"])


@query(
    "rendered_output",
    "section_texts",
    "templates",
    oracle=with_inputs(
        "section_texts",
        "templates",
        tables={
            "t": f"SELECT *, {_ERROR} AS problem FROM templates",
            "r": """SELECT *, text_id AS scope, CASE text_id % 4 WHEN 0 THEN 'minimal'
  WHEN 1 THEN 'team' WHEN 2 THEN 'jira' ELSE 'default' END AS template FROM section_texts""",
            "f": _FOUND,
            "v": f"SELECT text_id AS id, * EXCLUDE (text_id) FROM ({_VALUES})",
        },
        then=f"""SELECT text_id, template, status,
  coalesce({_render_sql("body")}, '') AS output FROM f JOIN v ON v.id = f.text_id""",
    ),
)
def rendered_output(texts, templates):
    name = F.expr(
        "CASE text_id % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'team' WHEN 2 THEN 'jira' "
        "ELSE 'default' END"
    )
    answers = texts.select(
        "text_id",
        F.col("text_id").alias("scope"),
        F.col("text").alias("response"),
        name.alias("template"),
        (F.col("text_id") % 7).alias("commits"),
        F.expr("slice(array('api', 'ops', 'web'), 1, CAST(text_id % 4 AS INT))").alias("repos"),
        F.lit("local").alias("provider"),
        F.concat(F.lit("u"), F.col("text_id").cast("string"), F.lit("@example.com")).alias(
            "author_email"
        ),
    )
    found = ot.look_up(answers, templates, ["scope"])
    return ot.render_answers(found, _NOW).select("text_id", "template", "status", "output")
