"""Queries over settings, check tables and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.checks.fixtures import with_inputs
from daybook.checks.registry import query
from daybook.functions import settings as fs
from daybook.operators import health, settings, usage
from daybook.plans import maintenance


@query(
    "settings_resolve",
    "settings_layers",
    oracle=with_inputs(
        "settings_layers",
        tables={
            "held": "SELECT * FROM settings_layers WHERE layer < 2 OR coalesce(value, '') <> ''",
            "top": """SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY layer DESC) AS rn
FROM held""",
        },
        then="""SELECT scope, key, value, layer FROM top a WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM held b WHERE b.scope = a.scope AND b.layer > a.layer
    AND (starts_with(a.key, b.key || '.') OR starts_with(b.key, a.key || '.')))""",
    ),
)
def settings_resolve(layers):
    return settings.resolve(layers)


def _documents(rows):
    """Settings documents as JSON text out of the flat rows, dealt over all tasks.

    The flat rows are dealt, by their unique key: the texts are several times as wide.
    """
    text = F.expr(
        """'{"repos": [' || repeat('"r", ', CAST(n_repos AS INT)) || '"r"], "author_email": "'
        || author_email || '", "hours_lookback": "' || hours_lookback || '", "tone": "' || tone
        || '", "slack_webhook_url": "' || webhook || '", "provider": {"name": "' || provider
        || '", "ollama": {"base_url": "' || base_url || '", "model": "m"}, "groq": {"model": "g",'
        || ' "api_key": ""}}, "rate_limit": {"enabled": true, "cooldown_minutes": "'
        || cooldown_minutes || '", "max_calls_per_day": "' || max_calls_per_day
        || '"}, "quality": {"enabled": true, "show_breakdown": false, "min_score": "' || min_score
        || '"}, "noise_filter_enabled": ' || noise_filter || ', "template": "' || template
        || '", "custom_templates": {"team": "{today}"}}'"""
    )
    return settings.dealt(rows, by=["scope"]).select("scope", text.alias("settings"))


_HOURS = """CASE WHEN CAST(hours_lookback AS INT) NOT BETWEEN 1 AND 720 THEN
  '{0}hours_lookback must be between 1 and 720, got: ' || CAST(hours_lookback AS INT) END"""
_ERRORS = f"""array_to_string(list_filter([
  CASE WHEN author_email <> '' AND NOT regexp_matches(author_email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
    THEN 'author_email: Invalid email format: ''' || author_email || '''' END,
  {_HOURS.format('hours_lookback: ')},
  CASE WHEN lower(trim(tone)) NOT IN ('casual', 'formal')
    THEN 'tone: tone must be one of (''casual'', ''formal''), got: ''' || tone || '''' END,
  CASE WHEN webhook <> '' AND NOT starts_with(webhook, 'https://hooks.slack.com/')
    THEN 'slack_webhook_url: slack_webhook_url must start with ''https://hooks.slack.com/'', got: '''
      || webhook || '''' END,
  CASE WHEN provider NOT IN ('ollama', 'groq')
    THEN 'provider: provider.name must be one of (''ollama'', ''groq''), got: ''' || provider || ''''
    WHEN NOT starts_with(base_url, 'http') THEN
      'provider: provider.ollama.base_url must be a valid URL, got: ''' || base_url || '''' END,
  'rate_limit: ' || nullif(array_to_string(list_filter([
    CASE WHEN CAST(cooldown_minutes AS INT) > 1440
      THEN 'rate_limit.cooldown_minutes must be between 0 and 1440.' END,
    CASE WHEN max_calls_per_day = 'x'
      THEN 'rate_limit.max_calls_per_day must be an integer, got: ''x'''
      WHEN CAST(max_calls_per_day AS INT) NOT BETWEEN 1 AND 50
      THEN 'rate_limit.max_calls_per_day must be between 1 and 50.' END],
    lambda x: x IS NOT NULL), ' | '), ''),
  CASE WHEN CAST(min_score AS INT) > 100
    THEN 'quality: quality.min_score must be between 0 and 100.' END,
  CASE WHEN template = 'lost' THEN 'template: template must be one of [''default'', ''detailed'','
    || ' ''jira'', ''minimal'', ''slack'', ''team''], got: ''lost''' END,
  CASE WHEN noise_filter <> 'true' THEN 'noise_filter_enabled must be a boolean.' END,
  CASE WHEN n_repos >= 20 THEN 'repos must contain at most 20 entries.' END,
  {_HOURS.format('')}], lambda x: x IS NOT NULL), ' ; ')"""


@query(
    "settings_validate",
    "settings_rows",
    oracle=with_inputs(
        "settings_rows",
        tables={"e": f"SELECT scope, {_ERRORS} AS errors FROM settings_rows"},
        then="SELECT scope, errors, errors = '' AS is_valid FROM e",
    ),
)
def settings_validate(rows):
    return settings.validate(_documents(rows), tasks=0).select(
        "scope", F.array_join("errors", " ; ").alias("errors"), "is_valid"
    )


@query(
    "arguments_validate",
    "customer",
    oracle="""SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 0 THEN '--hours and --week are mutually exclusive.' END,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 AND c_custkey % 7 <> 6 AND c_custkey % 7 + 8 <> 10
    THEN '--limit cannot be combined with history --clear.' END], lambda x: x IS NOT NULL), ' ; ')
  AS errors,
  CASE WHEN c_custkey % 9 = 0 THEN '--tail must be an integer, got: ''many'''
    WHEN c_custkey % 300 NOT BETWEEN 1 AND 200 THEN '--tail must be between 1 and 200.'
    ELSE '' END AS tail_error
FROM customer""",
)
def arguments_validate(customer):
    k = F.col("c_custkey")
    errors = fs.argument_errors(
        hours=k % 5,
        week=k % 3 == 0,
        command=F.when(k % 2 == 0, "history").otherwise("run"),
        clear=k % 4 == 0,
        limit=F.when(k % 7 != 6, k % 7 + 8),
    )
    tail = F.when(k % 9 == 0, "many").otherwise((k % 300).cast("string"))
    return customer.select(
        "c_custkey",
        F.array_join(errors, " ; ").alias("errors"),
        fs.bounded_int_error(tail, "--tail").alias("tail_error"),
    )


_STATUS = "CASE l_partkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' WHEN 2 THEN 'info' ELSE 'pass' END"


@query(
    "health_score",
    "lineitem",
    oracle=f"""SELECT l_orderkey, CAST(trunc(100 * (passed + 0.5::DOUBLE * warned) / n) AS INTEGER) AS score,
  passed, warned, failed, CASE WHEN trunc(100 * (passed + 0.5::DOUBLE * warned) / n) >= 80 THEN 'good'
    WHEN trunc(100 * (passed + 0.5::DOUBLE * warned) / n) >= 60 THEN 'fair' ELSE 'low' END AS band
FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (s = 'pass') AS passed,
  count(*) FILTER (s IN ('warn', 'info')) AS warned, count(*) FILTER (s = 'fail') AS failed
  FROM (SELECT l_orderkey, {_STATUS} AS s FROM lineitem) GROUP BY l_orderkey)""",
)
def health_score(lineitem):
    checks = lineitem.select("l_orderkey", F.expr(_STATUS).alias("status"))
    return health.score(checks, ["l_orderkey"])


@query(
    "maintenance_summary",
    "history",
    "calls",
    oracle=with_inputs(
        "history",
        "calls",
        tables={
            "d": """SELECT sum(n - 365)::BIGINT AS affected FROM (
  SELECT provider, count(*) AS n FROM history GROUP BY provider) WHERE n > 365""",
            "u": "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM calls",
        },
        then="""SELECT 'History cleanup' AS task, CASE WHEN affected IS NULL THEN 'No cleanup needed'
  ELSE affected || ' row(s) deleted' END AS result, coalesce(affected, 0) AS affected FROM d
UNION ALL SELECT 'Usage prune', 'Completed', count(*) FILTER (day < DATE '2024-02-14' - 30) FROM u""",
    ),
)
def maintenance_summary(history, calls):
    return maintenance.summary(history, usage.daily(calls), "2024-02-14 09:00:00", ["provider"])


@query(
    "table_health",
    "history",
    "part",
    "settings_rows",
    "keys",
    oracle=with_inputs(
        "history",
        "settings_rows",
        "keys",
        tables={
            "h": "SELECT count(*) AS n, coalesce(sum(strlen(standup_text)), 0)::BIGINT AS b FROM history",
            "s": f"""SELECT count(*) AS n, count(*) FILTER ({_ERRORS} <> '') AS bad
FROM settings_rows""",
            "k": """SELECT count(*) FILTER (key <> '' AND NOT (left(key, 4) = 'gsk' || '_'
  AND length(key) >= 40)) AS bad FROM keys""",
        },
        then="""SELECT 'History size' AS "check", CASE WHEN b > 20971520 THEN 'fail'
  WHEN b > 5242880 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN b < 1024 THEN b || ' B'
  WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.2f MB', b / 1048576.0) END AS detail
FROM h
UNION ALL SELECT 'History rows', 'pass', n::VARCHAR FROM h
UNION ALL SELECT 'History schema', CASE WHEN max(p_size) = 50 THEN 'pass' ELSE 'warn' END,
  max(p_size) || '/50' FROM part
UNION ALL SELECT 'Settings valid', CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END,
  bad || ' of ' || n || ' invalid' FROM s
UNION ALL SELECT 'Key format', CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END,
  bad || ' invalid key(s)' FROM k""",
    ),
)
def table_health(history, part, rows, keys):
    versions = part.select(F.col("p_size").alias("version"))
    return maintenance.table_health(history, versions, _documents(rows), keys, latest=50, tasks=0)
