"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run.

``$name`` stands for a given table.  Token-shaped literals are joined on purpose,
to keep secret scanners quiet.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

COMMITS_NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"

INPUTS = {
    "commits": """
SELECT o.o_orderkey AS seq, n.n_name AS repo, md5(CAST(o.o_orderkey AS STRING)) AS hash,
       'u' || CAST(c.c_custkey % 50 AS STRING) || '@example.com' AS author_email,
       o.o_orderdate + (o.o_orderkey % 1440) * INTERVAL '1' MINUTE AS committed_at,
       0 AS tz_offset_min,
       CASE o.o_orderkey % 22
         WHEN 0 THEN 'feat(auth): add login flow'
         WHEN 1 THEN 'fix: patch race condition'
         WHEN 2 THEN 'update README with setup notes'
         WHEN 3 THEN 'update GitHub Actions pipeline'
         WHEN 4 THEN 'Merge branch main into feature'
         WHEN 5 THEN 'WIP sketch'
         WHEN 6 THEN 'fixup! feat: add parser'
         WHEN 7 THEN '1.2.3'
         WHEN 8 THEN '   '
         WHEN 9 THEN 'misc cleanupish maybe'
         WHEN 10 THEN 'Revert last rollout'
         WHEN 11 THEN 'optimise the query path'
         WHEN 12 THEN 'Bump dependency set'
         WHEN 13 THEN 'chore: rotate password=hunter2 now'
         WHEN 14 THEN 'fix: host 10.20.30.40 via db.internal'
         WHEN 15 THEN 'docs: use Bearer abc.def-123'
         WHEN 16 THEN 'fix: rotate AKIA' || 'IOSFODNN7EXAMPLE for ci'
         WHEN 17 THEN 'feat: support KEY=VALUE parsing'
         WHEN 18 THEN 'fix: clone https://' || 'user:pw@host.example.com/x'
         WHEN 19 THEN 'refactor tokens' || chr(13) || chr(10) || 'body line'
         WHEN 20 THEN 'style!: rotate ghp_' || repeat('a', 36)
         ELSE chr(9) || 'test: cover edge rows ' || chr(10)
       END AS message
FROM $orders o JOIN $customer c ON o.o_custkey = c.c_custkey
JOIN $nation n ON c.c_nationkey = n.n_nationkey""",
    "commit_files": """
SELECT l_orderkey AS seq, l_linenumber AS pos, CAST(NULL AS STRING) AS a_path,
       CASE l_partkey % 4
         WHEN 0 THEN 'README.md'
         WHEN 1 THEN 'tests/test_' || CAST(l_partkey % 9 AS STRING) || '.py'
         WHEN 2 THEN 'src/mod' || CAST(l_suppkey % 7 AS STRING) || '/f'
                     || CAST(l_partkey % 5 AS STRING) || '.py'
         ELSE 'lib/core/deep/x.py' END AS b_path,
       CAST(l_quantity AS BIGINT) AS insertions, l_partkey % 40 AS deletions
FROM $lineitem""",
    # renamed, deleted, absolute, dotted and nameless paths
    "path_pairs": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS STRING)
         ELSE 'old/' || CAST(l_partkey % 11 AS STRING) || '/a.py' END AS a_path,
       CASE l_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS STRING)
         WHEN 2 THEN '/etc/app/' || CAST(l_partkey % 3 AS STRING)
         WHEN 3 THEN './src//x' || CAST(l_partkey % 3 AS STRING) || '/y.py'
         WHEN 4 THEN 'a/b'
         WHEN 5 THEN 'top' || CAST(l_partkey % 13 AS STRING) || '.md'
         ELSE 'pkg/sub' || CAST(l_partkey % 6 AS STRING) || '/deep/z.py' END AS b_path
FROM $lineitem""",
    "calls": "SELECT event_id AS call_id, user_id, ts FROM $events",
    "history": """
SELECT event_id AS id, ts AS created_at, md5(CAST(user_id % 10 AS STRING)) AS commit_hash,
       CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS provider,
       'm' || CAST(event_id % 3 AS STRING) AS model,
       CASE WHEN event_id % 2 = 0 THEN 'casual' ELSE 'formal' END AS tone,
       'text ' || CAST(event_id AS STRING) || chr(13) || chr(10) || 'line' AS standup_text,
       CASE event_id % 5 WHEN 0 THEN 'not valid json' WHEN 1 THEN '[]'
         ELSE '["api", "web"]' END AS repos,
       24 AS hours_lookback, CAST(floor(value) AS INT) % 101 AS quality_score, user_id
FROM $events""",
    "requests": """
SELECT event_id AS request_id, ts AS requested_at, md5(CAST(user_id % 12 AS STRING)) AS commit_hash,
       CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS provider,
       CASE WHEN event_id % 3 = 0 THEN 'casual' ELSE 'formal' END AS tone
FROM $events""",
    # runs of one to six attempts in turn, every event one attempt
    "attempts": """
SELECT run_id, attempt, 'draft ' || CAST(event_id AS STRING) AS response,
       CASE event_type
         WHEN 'error' THEN 'not json'
         WHEN 'click' THEN 'note {"score": "' || k || '", "issues": ["vague", " "], "strengths": []} end'
         WHEN 'view' THEN '{"score": ' || k || '.7, "issues": "single", "strengths": ["clear"]}'
         WHEN 'signup' THEN '{"score": ' || k || '0, "issues": [], "strengths": {}}'
         ELSE '{"score": -' || k || ', "issues": ["thin"], "strengths": ["short"]}' END AS raw
FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k,
             event_id - event_id % 21 + CASE WHEN p < 1 THEN 0 WHEN p < 3 THEN 1 WHEN p < 6 THEN 3
               WHEN p < 10 THEN 6 WHEN p < 15 THEN 10 ELSE 15 END AS run_id,
             p + 1 - CASE WHEN p < 1 THEN 0 WHEN p < 3 THEN 1 WHEN p < 6 THEN 3
               WHEN p < 10 THEN 6 WHEN p < 15 THEN 10 ELSE 15 END AS attempt
      FROM (SELECT *, event_id % 21 AS p FROM $events) n) e""",
    # every event as a scoring answer of its own
    "answers": """
SELECT event_id AS answer_id, event_type, user_id,
       CASE event_type
         WHEN 'error' THEN 'not json'
         WHEN 'click' THEN 'note {"score": "' || k || '", "issues": ["vague", " "], "strengths": []} end'
         WHEN 'view' THEN '{"score": ' || k || '.7, "issues": "single", "strengths": ["clear"]}'
         WHEN 'signup' THEN '{"score": ' || k || '0, "issues": [], "strengths": {}}'
         ELSE '{"score": -' || k || ', "issues": ["thin", "late"], "strengths": ["short"]}' END AS raw
FROM (SELECT event_id, event_type, user_id, regexp_extract(props, '([0-9]+)', 1) AS k
      FROM $events) e""",
    "log_lines": """
SELECT event_id AS seq,
       CASE WHEN event_id % 17 = 0 THEN 'not json' WHEN event_id % 19 = 0 THEN '[1, 2]'
         WHEN event_id % 23 = 0 THEN '{"event": "nan", "api_key": "k", "n": NaN, "ts": "2024-01-02T03:04:05"}'
         WHEN event_id % 29 = 0 THEN '{"event": "first", "user_token": "t", "event": "last"}'
         WHEN event_id % 31 = 0 THEN '{"event": "long", "n": ' || repeat('1234567890', 5) || ', "x": 1.50}'
         WHEN event_id % 37 = 0 THEN '{"event": "broken", "n": {1}}'
         WHEN event_id % 13 = 0 THEN
           '{"ts": "' || replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T')
           || '", "level": "INFO", "event": "' || event_type
           || '", "meta": {"path": "/x", "n": ' || CAST(user_id AS STRING)
           || ', "tag": ["a", "b"]}, "cached": true}'
         ELSE '{"api_key": "abc", "commit_count": ' || CAST(user_id AS STRING) || ', "event": "'
              || event_type || '", "level": "INFO", "provider": "local", "ts": "'
              || replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T')
              || '", "user_token": "t"}' END AS line
FROM $events""",
    "section_texts": """
SELECT p_partkey AS text_id, y, t, b,
       CASE p_partkey % 2
         WHEN 0 THEN '**Yesterday:** ' || y || chr(10) || '**Today:** ' || t || chr(10)
                     || '**Blockers:** ' || b
         ELSE 'Yesterday: ' || y || chr(10) || 'Today: ' || t || chr(10)
              || 'Impediments: ' || b END AS text
FROM (SELECT p_partkey, 'built part ' || CAST(p_partkey AS STRING) AS y, 'check ' || p_brand AS t,
             CASE WHEN p_size % 3 = 0 THEN 'None'
               ELSE 'size ' || CAST(p_size AS STRING) END AS b FROM $part) p""",
    "settings_layers": """
SELECT c_custkey AS scope, 'tone' AS key, 'casual' AS value, 0 AS layer FROM $customer
UNION ALL SELECT c_custkey, 'rate_limit.cooldown_minutes', '30', 0 FROM $customer
UNION ALL SELECT c_custkey, 'provider.api_key', '', 0 FROM $customer
UNION ALL SELECT c_custkey, 'tone', CASE WHEN c_custkey % 6 = 0 THEN CAST(NULL AS STRING)
  ELSE 'formal' END, 1 FROM $customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'provider.api_key', 'file', 1 FROM $customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'rate_limit', 'off', 1 FROM $customer WHERE c_custkey % 9 = 0
UNION ALL SELECT c_custkey, 'provider.api_key', 'chain', 2 FROM $customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'provider.api_key', 'env', 3 FROM $customer WHERE c_custkey % 7 = 0""",
    "settings_rows": """
SELECT c_custkey AS scope,
       CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a@b.co' WHEN 2 THEN 'bad'
         ELSE 'a b@c.d' END AS author_email,
       CAST(c_custkey * 7 % 800 AS STRING) AS hours_lookback,
       CASE c_custkey % 3 WHEN 0 THEN ' Casual' WHEN 1 THEN 'formal' ELSE 'angry' END AS tone,
       CAST(c_custkey % 1500 AS STRING) AS cooldown_minutes,
       CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE CAST(c_custkey % 60 AS STRING) END
         AS max_calls_per_day,
       CAST(c_custkey % 120 AS STRING) AS min_score,
       CASE c_custkey % 5 WHEN 0 THEN 'nope' WHEN 1 THEN 'groq' ELSE 'ollama' END AS provider,
       CASE c_custkey % 8 WHEN 0 THEN 'http://x' WHEN 1 THEN 'https://hooks.slack.com/T1'
         ELSE '' END AS webhook,
       CASE c_custkey % 10 WHEN 0 THEN '1' WHEN 1 THEN 'null' ELSE 'true' END AS noise_filter,
       CASE c_custkey % 13 WHEN 0 THEN 'team' WHEN 1 THEN 'lost' ELSE 'default' END AS template,
       CASE WHEN c_custkey % 14 = 0 THEN 'ftp://x' ELSE 'http://localhost:11434' END AS base_url,
       c_custkey % 23 AS n_repos
FROM $customer""",
    "templates": """
SELECT p_partkey AS scope,
       CASE p_partkey % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'team' ELSE 'mine-' || p_brand END AS name,
       CASE p_partkey % 10
         WHEN 0 THEN '**Yesterday:** {yesterday} **Today:** {today} **Blockers:** {blockers}'
         WHEN 1 THEN p_brand || ': {yesterday}'
         WHEN 2 THEN '{yesterday}{mystery}{today}{alpha}'
         WHEN 3 THEN '{yesterday:>10} ' || p_name
         WHEN 4 THEN '{yesterday.x}'
         WHEN 5 THEN '{{yesterday}}'
         WHEN 6 THEN '  '
         WHEN 7 THEN 'plain ' || p_name
         WHEN 8 THEN repeat('x', 2000) || '{today}'
         ELSE '{date} {time} {provider}/{repos} ' || p_type || ' {commit_count}' END AS body
FROM $part""",
    "template_requests": """
SELECT l_orderkey, l_linenumber, l_partkey AS scope, l_suppkey,
       CASE l_suppkey % 5 WHEN 0 THEN 'minimal' WHEN 1 THEN 'team' WHEN 2 THEN 'default'
         WHEN 3 THEN 'jira' ELSE 'nowhere' END AS template
FROM $lineitem""",
    # token-shaped keys of several lengths
    "keys": """
SELECT c_custkey AS owner,
       CASE c_custkey % 5
         WHEN 0 THEN ''
         WHEN 1 THEN 'short' || CAST(c_custkey % 7 AS STRING)
         WHEN 2 THEN 'gsk' || '_' || repeat('k', CAST(20 + c_custkey % 30 AS INT))
         WHEN 3 THEN 'gsk' || '_' || md5(CAST(c_custkey AS STRING)) || 'tail'
         ELSE md5(CAST(c_custkey AS STRING)) END AS key
FROM $customer""",
    "error_texts": """
SELECT e.event_id AS error_id,
       CASE e.event_id % 11 WHEN 0 THEN 'FileNotFoundError' WHEN 1 THEN 'PermissionError'
         WHEN 2 THEN 'TimeoutError' WHEN 3 THEN 'JSONDecodeError' WHEN 4 THEN 'sqlite3.Error'
         ELSE 'ValueError' END AS error_class,
       CASE e.user_id % 7
         WHEN 0 THEN 'failed at C:' || chr(92) || 'Users' || chr(92) || 'name' || chr(92) || 'secret.txt'
         WHEN 1 THEN 'cannot open /Users/tester/project/config.json now'
         WHEN 2 THEN 'contact me at dev' || CAST(e.user_id AS STRING) || '@example.com please'
         WHEN 3 THEN 'key gsk' || '_' || 'abcdefghijkl0123 refused   twice'
         WHEN 4 THEN repeat('long text ', 40) || e.event_type
         WHEN 5 THEN '   '
         ELSE e.event_type || chr(10) || chr(9) || ' failed for ' || e.props END AS message
FROM $events e""",
}


def for_spark(name: str, sf_dir: str) -> str:
    """Input SQL reading the parquet files directly."""
    return re.sub(
        r"\$(\w+)", lambda m: f"parquet.`{sf_dir.rstrip('/')}/{m.group(1)}.parquet`", INPUTS[name]
    )


def for_duckdb(name: str) -> str:
    return re.sub(r"\$(\w+)", r"\1", INPUTS[name])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input, or a given table when no input has that name."""
    if name in INPUTS:
        return spark.sql(for_spark(name, sf_dir))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_inputs(*names: str, then: str, tables: dict[str, str] | None = None) -> str:
    """Oracle SQL: the named inputs and further tables as common tables, then the statement."""
    parts = {n: for_duckdb(n) for n in names} | (tables or {})
    head = ",\n".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in parts.items())
    return f"WITH RECURSIVE {head}\n{then}" if parts else then
