"""Pieces of oracle SQL, written for DuckDB's own functions and pattern dialect."""

from __future__ import annotations

WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(x: str) -> str:
    return f"trim({x}, '{WHITE}')"


def subject(x: str) -> str:
    return f"coalesce(left(regexp_extract({strip(x)}, '^[^\\n\\r]*'), 500), '')"


def has_word(x: str, words: str) -> str:
    return f"regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])')"


def starts_word(x: str, words: str) -> str:
    return f"regexp_matches({x}, '(?i)^({words})($|[^\\p{{L}}\\p{{N}}_])')"


def noise(x: str) -> str:
    s = strip(x)
    return (
        f"(coalesce({s}, '') = '' OR regexp_matches({s}, "
        "'(?i)^(merge (branch|pull request|remote)|wip($|[^\\p{L}\\p{N}_])|bump version"
        "|[0-9]+\\.[0-9]+\\.[0-9]+$|update (changelog|readme)$|initial commit$|fixup!|squash!)'))"
    )


def classify(x: str) -> str:
    s = strip(x)
    prefix = (
        f"lower(regexp_extract({s}, '(?i)^(feat|fix|refactor|test|docs|chore|ci|perf|style|revert)"
        "(\\([^)]+\\))?!?:', 1))"
    )
    return f"""CASE WHEN coalesce({s}, '') = '' THEN 'unknown'
 WHEN {prefix} <> '' THEN {prefix}
 WHEN {starts_word(s, 'merge|merged')} THEN 'merge'
 WHEN {starts_word(s, 'wip')} OR regexp_matches({s}, '(?i)work in progress') THEN 'wip'
 WHEN {starts_word(s, 'revert|rollback')} THEN 'revert'
 WHEN {has_word(s, 'ci|cd|workflow|github actions|pipeline')} THEN 'ci'
 WHEN {has_word(s, 'doc|docs|readme|changelog|comment')} THEN 'docs'
 WHEN {has_word(s, 'test|tests|spec|pytest|unittest')} THEN 'test'
 WHEN {has_word(s, 'refactor|cleanup|simplify|restructure')} THEN 'refactor'
 WHEN {has_word(s, 'perf|performance|optimi[sz]e|faster')} THEN 'perf'
 WHEN {has_word(s, 'style|format|lint|prettier|black|whitespace')} THEN 'style'
 WHEN {has_word(s, 'fix|bug|hotfix|patch|resolve')} THEN 'fix'
 WHEN {has_word(s, 'add|adds|added|implement|implements|implemented|create|introduce|feature')}
   THEN 'feat'
 WHEN {has_word(s, 'chore|deps|dependency|dependencies|bump|release|maintenance')} THEN 'chore'
 ELSE 'unknown' END"""


def emoji(x: str) -> str:
    return f"CASE {x} WHEN 'feat' THEN '✨' WHEN 'fix' THEN '\U0001f41b' ELSE '' END"


REDACTIONS = (
    (
        "[REDACTED]",
        "(?i)(password|passwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key"
        "|private[_-]?key|auth[_-]?token)\\s*[=:]\\s*(?:\"[^\"]*\"|''[^'']*''|\\S+)",
    ),
    (
        "[REDACTED]",
        "\\b(?:10\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}|172\\.(?:1[6-9]|2\\d|3[01])\\.\\d{1,3}\\.\\d{1,3}"
        "|192\\.168\\.\\d{1,3}\\.\\d{1,3})\\b",
    ),
    ("[REDACTED]", "(?i)\\b\\w[\\w.-]+\\.(?:local|internal|corp|lan)\\b"),
    ("[REDACTED]", "(?i)bearer\\s+[A-Za-z0-9\\-._~+/]+=*"),
    (
        "[REDACTED:GITHUB_TOKEN]",
        "\\bghp_[A-Za-z0-9]{36}\\b|\\bgithub_pat_[A-Za-z0-9_]{20,}\\b",
    ),
    ("[REDACTED:API_KEY]", "\\bsk-(?:ant-api03-|proj-)?[A-Za-z0-9_-]{20,}\\b"),
    ("[REDACTED:GROQ_KEY]", "\\bgsk_[A-Za-z0-9_-]{10,}\\b"),
    ("[REDACTED:AWS_KEY]", "\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b"),
    ("[REDACTED:SLACK_TOKEN]", "\\bxox[baprs]-[A-Za-z0-9-]{10,}\\b"),
    ("[REDACTED:URI_CREDENTIALS]", "\\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\\s:@/]+:[^\\s@/]+@"),
)


def redact(x: str) -> str:
    for replacement, pattern in REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


def redaction_steps(table: str, key: str, text: str) -> dict[str, str]:
    """Common tables r0..r10: text and hits after each rule."""
    steps = {"r0": f"SELECT {key}, {text} AS text, 0 AS hits FROM {table}"}
    for i, (replacement, pattern) in enumerate(REDACTIONS):
        steps[f"r{i + 1}"] = (
            f"SELECT {key}, regexp_replace(text, '{pattern}', '{replacement}', 'g') AS text, "
            f"hits + len(regexp_extract_all(text, '{pattern}')) AS hits FROM r{i}"
        )
    return steps


def module(path: str) -> str:
    """Second of three or more parts, else the first; absolute paths start with '/'."""
    parts = (
        f"(CASE WHEN {path} LIKE '/%' THEN ['/'] ELSE [] END || "
        f"list_filter(string_split({path}, '/'), lambda p: p <> '' AND p <> '.'))"
    )
    return f"CASE WHEN len({parts}) >= 3 THEN {parts}[2] ELSE {parts}[1] END"


CHANGED_PATH = "coalesce(nullif(b_path, ''), nullif(a_path, ''))"

FILE_TOTALS = f"""SELECT seq, count({CHANGED_PATH}) AS n_files,
  sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions,
  list_sort(list_distinct(list({module(CHANGED_PATH)}))) AS modules,
  list({CHANGED_PATH} ORDER BY pos, {CHANGED_PATH})[1:5] AS first_paths
FROM commit_files GROUP BY seq"""


def line(message: str) -> str:
    """Printed digest line of a commit with type, emoji and file totals."""
    return f"""rtrim('- [' || strftime(committed_at, '%H:%M') || '] '
 || CASE WHEN type_emoji <> '' THEN type_emoji || ' ' ELSE '' END || '(' || type || ') '
 || {redact(message)})
 || CASE WHEN n_files > 0 THEN ' -> files: ' || array_to_string(first_paths, ', ')
      || CASE WHEN n_files > 5 THEN ' (+' || (n_files - 5) || ' more)' ELSE '' END ELSE '' END
 || ' (+' || insertions || '/-' || deletions || ')'"""


# Commits capped per author, day and repository, with type, emoji and file totals.
CAPPED = {
    "file_totals": FILE_TOTALS,
    "capped": f"""SELECT * EXCLUDE (rn) FROM (
  SELECT c.seq, repo, left(hash, 7) AS hash, author_email, committed_at,
    CAST(committed_at AS DATE) AS day, {subject('message')} AS message,
    row_number() OVER (PARTITION BY author_email, CAST(committed_at AS DATE), repo
                       ORDER BY committed_at DESC, c.seq) AS rn
  FROM commits c) WHERE rn <= 200""",
    "full_rows": f"""SELECT c.*, coalesce(n_files, 0) AS n_files,
    coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions,
    coalesce(modules, []) AS modules, coalesce(first_paths, []) AS first_paths,
    {noise('message')} AS noise, {classify('message')} AS type
  FROM capped c LEFT JOIN file_totals f ON f.seq = c.seq""",
    "annotated": f"SELECT *, {emoji('type')} AS type_emoji FROM full_rows",
}


def digest_tables(source: str) -> dict[str, str]:
    """Digest text and fingerprint per author and day out of annotated rows."""
    return {
        "blocks": f"""SELECT author_email, day, repo, min(seq) AS first_seq,
    'REPO: ' || repo || chr(10) || string_agg({line('message')}, chr(10) ORDER BY seq)
      || chr(10) AS block
  FROM {source} GROUP BY author_email, day, repo""",
        "texts": """SELECT author_email, day, string_agg(block, chr(10) ORDER BY first_seq) AS body
  FROM blocks GROUP BY author_email, day""",
        "facts": f"""SELECT author_email, day, count(*) AS commits,
    sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions,
    list_sort(list_distinct(flatten(list(modules)))) AS modules,
    list_sort(list_distinct(list(repo))) AS repos,
    sha256(string_agg(hash, chr(10) ORDER BY hash)) AS fingerprint
  FROM {source} GROUP BY author_email, day""",
        "digests": """SELECT f.author_email, f.day, commits, insertions, deletions,
    array_to_string(repos, ', ') AS repos, fingerprint,
    body || chr(10) || 'SUMMARY: ' || commits || ' commit(s), +' || insertions || '/-' || deletions
      || ' lines, modules: '
      || CASE WHEN len(modules) > 0 THEN array_to_string(modules, ', ') ELSE 'n/a' END AS digest
  FROM facts f JOIN texts t ON t.author_email = f.author_email AND t.day = f.day""",
    }


KEPT = """SELECT * EXCLUDE (has_signal) FROM (
  SELECT *, bool_or(NOT noise) OVER (PARTITION BY author_email, day) AS has_signal FROM annotated)
WHERE NOT noise OR NOT has_signal"""
