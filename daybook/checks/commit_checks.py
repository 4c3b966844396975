"""Queries over commits: scan, filters, cap, types, totals and digests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from daybook.checks import sqltext as q
from daybook.checks.fixtures import COMMITS_NOW, with_inputs
from daybook.checks.registry import query
from daybook.functions import commits as fc
from daybook.functions.text import subject_line
from daybook.operators import commits as oc
from daybook.operators import folds
from daybook.plans import daily
from daybook.sources.tables import union_repos

RUN = ["author_email", "day"]


def _daily(commits):
    return commits.withColumn("day", F.to_date("committed_at"))


def _capped(commits):
    kept = oc.cap_newest(_daily(commits), [*RUN, "repo"]).drop("truncated")
    return oc.with_subject(kept).withColumn("hash", F.left("hash", F.lit(7)))


@query(
    "commit_scan",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables={
            "f": f"""SELECT seq, count({q.CHANGED_PATH}) AS n_files,
  sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions,
  array_to_string(list_sort(list_distinct(list({q.module(q.CHANGED_PATH)}))), ',') AS modules
FROM commit_files GROUP BY seq"""
        },
        then=f"""SELECT c.seq, repo, left(hash, 7) AS hash, author_email,
  {q.subject('message')} AS message, strftime(committed_at, '%Y-%m-%d %H:%M') AS timestamp,
  coalesce(n_files, 0) AS n_files, coalesce(insertions, 0) AS insertions,
  coalesce(deletions, 0) AS deletions, coalesce(modules, '') AS modules
FROM commits c LEFT JOIN f ON f.seq = c.seq""",
    ),
)
def commit_scan(commits, files):
    return oc.scan(commits, files).select(
        "seq",
        "repo",
        "hash",
        "author_email",
        "message",
        "timestamp",
        "n_files",
        "insertions",
        "deletions",
        F.array_join("modules", ",").alias("modules"),
    )


@query(
    "commit_paths",
    "path_pairs",
    oracle=with_inputs(
        "path_pairs",
        then=f"""SELECT l_orderkey AS seq, l_linenumber AS pos, {q.CHANGED_PATH} AS path
FROM path_pairs WHERE {q.CHANGED_PATH} IS NOT NULL""",
    ),
)
def commit_paths(pairs):
    return oc.paths(pairs.withColumnsRenamed({"l_orderkey": "seq", "l_linenumber": "pos"}))


@query(
    "commit_union_repos",
    "commits",
    oracle=with_inputs(
        "commits",
        then="""SELECT repo, count(*) AS commits, min(seq) AS first_seq, max(seq) AS last_seq
FROM commits GROUP BY repo""",
    ),
)
def commit_union_repos(commits):
    # two exports with their columns in another order, told apart by author
    early = commits.filter(F.col("author_email") < "u3")
    late = commits.filter(F.col("author_email") >= "u3").select(*reversed(commits.columns))
    both = union_repos([early, late])
    return both.groupBy("repo").agg(
        F.count("*").alias("commits"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


@query(
    "lookback_filter",
    "commits",
    oracle=with_inputs(
        "commits",
        then=f"""SELECT seq, repo FROM commits
WHERE committed_at >= TIMESTAMP '{COMMITS_NOW}' - INTERVAL 720 HOUR""",
    ),
)
def lookback_filter(commits):
    return oc.lookback(commits, COMMITS_NOW, 720).select("seq", "repo")


@query(
    "lookback_strict_walk",
    "commits",
    oracle=with_inputs(
        "commits",
        tables={
            "walk": """SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq % 97, seq) AS step
FROM commits""",
            "judged": """SELECT repo, seq, bool_or(committed_at < TIMESTAMP '1999-01-01')
  OVER (PARTITION BY repo ORDER BY step ROWS UNBOUNDED PRECEDING) AS stopped FROM walk""",
        },
        then="SELECT repo, seq FROM judged WHERE NOT stopped",
    ),
)
def lookback_strict_walk(commits):
    # a walk order that leaves the window early in some repositories
    walk = commits.withColumn("step", F.struct((F.col("seq") % 97).alias("a"), "seq"))
    return oc.lookback_strict_walk(walk, "1999-01-01 00:00:00", 0, seq="step").select("repo", "seq")


@query(
    "lookback_hours",
    "customer",
    oracle="""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 168
  WHEN c_custkey % 4 <> 0 AND c_custkey % 50 <> 0 THEN c_custkey % 50
  WHEN c_custkey % 3 <> 0 THEN c_custkey % 100 ELSE 24 END::BIGINT AS hours FROM customer""",
)
def lookback_hours(customer):
    k = F.col("c_custkey")
    return customer.select(
        "c_custkey",
        fc.lookback_hours(
            k % 6 == 0, F.when(k % 4 != 0, k % 50), F.when(k % 3 != 0, k % 100)
        ).alias("hours"),
    )


@query(
    "author_filter",
    "commits",
    "supplier",
    oracle=with_inputs(
        "commits",
        then="""SELECT seq, author_email FROM commits WHERE author_email IN
  (SELECT 'u' || (s_suppkey % 60) || '@example.com' FROM supplier WHERE s_suppkey % 3 = 0)""",
    ),
)
def author_filter(commits, supplier):
    wanted = supplier.filter("s_suppkey % 3 = 0").select(
        F.concat(
            F.lit("u"), (F.col("s_suppkey") % 60).cast("string"), F.lit("@example.com")
        ).alias("author_email")
    )
    return oc.by_author(commits, wanted).select("seq", "author_email")


@query(
    "subject_line",
    "commits",
    "documents",
    oracle=with_inputs(
        "commits",
        then=f"""SELECT 'c' || seq AS id, {q.subject('message')} AS subject FROM commits
UNION ALL SELECT 'd' || doc_id, {q.subject('text')} FROM documents""",
    ),
)
def subject(commits, documents):
    texts = commits.select(
        F.concat(F.lit("c"), F.col("seq").cast("string")).alias("id"), F.col("message").alias("text")
    ).unionByName(
        documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    )
    return texts.select("id", subject_line("text").alias("subject"))


@query(
    "changed_path",
    "path_pairs",
    oracle=with_inputs(
        "path_pairs",
        then=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {q.CHANGED_PATH} AS path
FROM path_pairs WHERE {q.CHANGED_PATH} IS NOT NULL""",
    ),
)
def changed_path(pairs):
    return pairs.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        fc.changed_path("a_path", "b_path").alias("path"),
    ).filter(F.col("path").isNotNull())


@query(
    "modules",
    "path_pairs",
    oracle=with_inputs(
        "path_pairs",
        tables={
            "named": f"""SELECT l_orderkey, {q.CHANGED_PATH} AS path FROM path_pairs
WHERE {q.CHANGED_PATH} IS NOT NULL"""
        },
        then=f"""SELECT l_orderkey,
  array_to_string(list_sort(list_distinct(list({q.module('path')}))), ',') AS modules
FROM named GROUP BY l_orderkey""",
    ),
)
def modules(pairs):
    named = changed_path(pairs)
    per_commit = named.groupBy("l_orderkey").agg(F.collect_set("path").alias("paths"))
    return per_commit.select(
        "l_orderkey", F.array_join(fc.modules("paths"), ",").alias("modules")
    )


@query(
    "noise_flag",
    "commits",
    oracle=with_inputs("commits", then=f"SELECT seq, {q.noise('message')} AS noise FROM commits"),
)
def noise_flag(commits):
    return commits.select("seq", fc.is_noise("message").alias("noise"))


@query(
    "noise_filter_fallback",
    "commits",
    oracle=with_inputs(
        "commits",
        tables={
            "flagged": f"""SELECT seq, author_email, CAST(committed_at AS DATE) AS day,
  {q.noise('message')} AS noise FROM commits"""
        },
        then="""SELECT seq, author_email FROM (SELECT *, bool_or(NOT noise) OVER
  (PARTITION BY author_email, day) AS has_signal FROM flagged) WHERE NOT noise OR NOT has_signal""",
    ),
)
def noise_filter_fallback(commits):
    return oc.drop_noise(_daily(commits), RUN).select("seq", "author_email")


@query(
    "classify",
    "commits",
    "documents",
    oracle=with_inputs(
        "commits",
        then=f"""SELECT 'c' || seq AS id, {q.classify(q.subject('message'))} AS type FROM commits
UNION ALL SELECT 'd' || doc_id, {q.classify(q.subject('text'))} FROM documents""",
    ),
)
def classify(commits, documents):
    return oc.annotate(subject(commits, documents), "subject").select("id", "type")


@query(
    "annotate",
    "commits",
    oracle=with_inputs(
        "commits",
        tables={"t": f"SELECT seq, {q.classify('message')} AS type FROM commits"},
        then=f"SELECT seq, type, {q.emoji('type')} AS type_emoji FROM t",
    ),
)
def annotate(commits):
    return oc.annotate(commits).select("seq", "type", "type_emoji")


@query(
    "type_label",
    "events",
    oracle="""SELECT event_id, CASE k WHEN 'feat' THEN 'Feature' WHEN 'fix' THEN 'Bug Fix'
  WHEN 'ci' THEN 'CI/CD' WHEN 'wip' THEN 'WIP' WHEN 'perf' THEN 'Performance' ELSE 'Other' END AS label,
  CASE k WHEN 'feat' THEN '✨' WHEN 'fix' THEN '\U0001f41b' ELSE '' END AS emoji
FROM (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'ci'
  WHEN 3 THEN 'wip' WHEN 4 THEN 'perf' ELSE event_type END AS k FROM events)""",
)
def type_label(events):
    key = F.expr(
        "CASE user_id % 6 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'ci' "
        "WHEN 3 THEN 'wip' WHEN 4 THEN 'perf' ELSE event_type END"
    )
    return events.withColumn("k", key).select(
        "event_id",
        fc.type_attribute("k", 2).alias("label"),
        fc.type_attribute("k", 1).alias("emoji"),
    )


@query(
    "type_summary",
    "commits",
    oracle=with_inputs(
        "commits",
        tables={"t": f"SELECT repo, {q.classify('message')} AS type FROM commits"},
        then="SELECT repo, type, count(*) AS n FROM t GROUP BY repo, type",
    ),
)
def type_summary(commits):
    return oc.count_by_type(commits, ["repo"])


@query(
    "commit_cap",
    "commits",
    oracle=with_inputs(
        "commits",
        then="""SELECT repo, seq, n >= 200 AS truncated FROM (SELECT repo, seq,
  row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, seq) AS rn,
  count(*) OVER (PARTITION BY repo) AS n FROM commits) WHERE rn <= 200""",
    ),
)
def commit_cap(commits):
    return oc.cap_newest(commits).select("repo", "seq", "truncated")


@query(
    "files_preview",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables={"file_totals": q.FILE_TOTALS},
        then="""SELECT c.seq, CASE WHEN coalesce(n_files, 0) = 0 THEN '' ELSE
  array_to_string(first_paths, ', ')
  || CASE WHEN n_files > 5 THEN ' (+' || (n_files - 5) || ' more)' ELSE '' END END AS preview
FROM commits c LEFT JOIN file_totals f ON f.seq = c.seq""",
    ),
)
def files_preview(commits, files):
    return oc.with_file_totals(commits.select("seq"), files).select(
        "seq", fc.files_preview("first_paths", "n_files").alias("preview")
    )


@query(
    "commit_line",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=q.CAPPED,
        then=f"SELECT seq, {q.line('message')} AS line FROM annotated",
    ),
)
def commit_line(commits, files):
    full = oc.annotate(oc.with_file_totals(_capped(commits), files))
    return oc.with_lines(full).select("seq", "line")


@query(
    "digest_totals",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables={"file_totals": q.FILE_TOTALS},
        then="""SELECT repo, count(*) AS commits, sum(coalesce(insertions, 0))::BIGINT AS insertions,
  sum(coalesce(deletions, 0))::BIGINT AS deletions,
  coalesce(nullif(array_to_string(list_sort(list_distinct(flatten(list(coalesce(modules, []))))),
    ', '), ''), 'n/a') AS modules
FROM commits c LEFT JOIN file_totals f ON f.seq = c.seq GROUP BY repo""",
    ),
)
def digest_totals(commits, files):
    named = F.when(F.size("modules") > 0, F.array_join("modules", ", ")).otherwise("n/a")
    full = oc.with_file_totals(commits, files)
    return oc.totals(full, ["repo"]).withColumn("modules", named)


@query(
    "repo_names",
    "commits",
    oracle=with_inputs(
        "commits",
        then="""SELECT author_email, array_to_string(list_sort(list_distinct(list(repo))), ', ')
  AS repos FROM commits GROUP BY author_email""",
    ),
)
def repo_names(commits):
    named = oc.repo_names(commits, ["author_email"])
    return named.withColumn("repos", F.array_join("repos", ", "))


@query(
    "fingerprint",
    "commits",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=q.CAPPED,
        then="""SELECT author_email, day, sha256(string_agg(hash, chr(10) ORDER BY hash))
  AS fingerprint FROM capped GROUP BY author_email, day""",
    ),
)
def fingerprint(commits):
    return oc.fingerprint(_capped(commits), RUN)


@query(
    "digest_text",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=q.CAPPED | q.digest_tables("annotated"),
        then="SELECT author_email, day, digest FROM digests",
    ),
)
def digest_text(commits, files):
    return daily.author_days(commits, files, filter_noise=False).select(*RUN, "digest")


@query(
    "prompt_text",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=q.CAPPED | {"kept": q.KEPT} | q.digest_tables("kept"),
        then="""SELECT author_email, day, 'Here is my recent git activity:' || chr(10) || chr(10)
  || digest || chr(10) || chr(10)
  || 'Please generate a daily standup summary from this data. Pay attention to the commit type '
  || 'labels so features, fixes, refactors, and supporting work are described accurately. '
  || CASE WHEN commits % 2 = 0 THEN 'Use a casual, friendly tone.'
       ELSE 'Use a formal, professional tone.' END
  || ' Format it as:' || chr(10) || '**Yesterday:** what I worked on' || chr(10)
  || '**Today:** what I plan to do' || chr(10) || '**Blockers:** any blockers (or ''None'')'
  || chr(10) AS prompt FROM digests""",
    ),
)
def prompt_text(commits, files):
    tone = F.when(F.col("commits") % 2 == 0, "casual").otherwise("blunt")
    return daily.author_days(commits, files).select(
        *RUN, fc.prompt_text("digest", tone).alias("prompt")
    )


_RECENT = q.CAPPED | {
    "capped": q.CAPPED["capped"].replace(
        "FROM commits c)",
        f"""FROM commits c WHERE committed_at >= TIMESTAMP '{COMMITS_NOW}' - INTERVAL 720 HOUR
    AND author_email IN ('u1@example.com', 'u2@example.com', 'u7@example.com'))""",
    )
}


@query(
    "recent_digest",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=_RECENT | {"kept": q.KEPT} | q.digest_tables("kept"),
        then="SELECT author_email, day, commits, digest, fingerprint FROM digests",
    ),
)
def recent_digest(commits, files):
    authors = ["u1@example.com", "u2@example.com", "u7@example.com"]
    return daily.author_days(commits, files, COMMITS_NOW, 720, authors).select(
        *RUN, "commits", "digest", "fingerprint"
    )


_WEEK = {
    k: re.sub(r"CAST\(committed_at AS DATE\) AS day,\s*", "", sql)
    .replace("author_email, CAST(committed_at AS DATE), repo", "author_email, repo")
    .replace(
        "FROM commits c)",
        f"FROM commits c WHERE committed_at >= TIMESTAMP '{COMMITS_NOW}' - INTERVAL 168 HOUR)",
    )
    for k, sql in q.CAPPED.items()
}


def _per_author(sql: str) -> str:
    """The same statement without the day."""
    return (
        sql.replace("author_email, day", "author_email")
        .replace("f.author_email, f.day", "f.author_email")
        .replace(" AND t.day = f.day", "")
    )


_WEEK_DIGESTS = {k: _per_author(v) for k, v in q.digest_tables("kept").items()}


@query(
    "weekly_digest",
    "commits",
    "commit_files",
    "orders",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=_WEEK
        | {"kept": _per_author(q.KEPT)}
        | _WEEK_DIGESTS
        | {
            "answers": f"""SELECT left(md5(CAST(o_orderkey AS STRING)), 7) AS hash, o_orderkey AS id,
  TIMESTAMP '{COMMITS_NOW}' + INTERVAL '1' HOUR * (o_orderkey % 30 - 3) AS created_at FROM orders""",
        },
        then=f"""SELECT author_email, commits, digest, fingerprint, id IS NOT NULL AS hit, id AS history_id
FROM (SELECT d.*, a.id, row_number() OVER (PARTITION BY d.author_email ORDER BY a.created_at DESC, a.id DESC) AS rn
  FROM digests d LEFT JOIN answers a ON sha256(a.hash) = d.fingerprint
    AND CAST(a.created_at AS DATE) = CAST(TIMESTAMP '{COMMITS_NOW}' AS DATE)) WHERE rn = 1""",
    ),
)
def weekly_digest(commits, files, orders):
    answers = orders.selectExpr(
        "o_orderkey AS id",
        f"TIMESTAMP_NTZ '{COMMITS_NOW}' + INTERVAL '1' HOUR * (o_orderkey % 30 - 3) AS created_at",
        "sha2(left(md5(CAST(o_orderkey AS STRING)), 7), 256) AS commit_hash",
        "'casual' AS tone",
        "'local' AS provider",
        "'answer' AS standup_text",
        "0 AS quality_score",
    )
    digests = daily.author_windows(commits, files, COMMITS_NOW, 168)
    return daily.with_reuse(digests, answers, "casual", "local", requested_at=COMMITS_NOW).select(
        "author_email", "commits", "digest", "fingerprint", "hit", "history_id"
    )


# Whole histories per author: no cap.
_WHOLE = {k: _per_author(v) for k, v in (q.CAPPED | q.digest_tables("annotated")).items()} | {
    "capped": q.CAPPED["capped"].replace(" WHERE rn <= 200", "")
}


@query(
    "fingerprint_whole",
    "commits",
    oracle=with_inputs(
        "commits",
        then="""SELECT author_email, sha256(string_agg(hash, chr(10) ORDER BY hash)) AS fingerprint
FROM commits GROUP BY author_email""",
    ),
)
def fingerprint_whole(commits):
    return folds.fingerprint_any_size(commits, ["author_email"])


@query(
    "digest_whole",
    "commits",
    "commit_files",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=_WHOLE,
        then="SELECT author_email, length(digest) AS n_chars, sha256(digest) AS sha256 FROM digests",
    ),
)
def digest_whole(commits, files):
    full = oc.with_file_totals(oc.with_subject(commits), files)
    parts = folds.digest_parts(oc.with_lines(oc.annotate(full)), ["author_email"])
    return parts.groupBy("author_email").agg(F.max("n_chars").alias("n_chars"), F.max_by("sha256", "part").alias("sha256"))


# Earlier answers for runs of one commit, so that some digests can be reused.
_EARLIER = """SELECT o_orderkey AS id, o_orderdate + INTERVAL '20' HOUR AS created_at,
  {sha}(left(md5(CAST(o_orderkey AS STRING)), 7){bits}) AS commit_hash,
  CASE WHEN o_orderkey % 3 = 0 THEN 'formal' ELSE 'casual' END AS tone, 'local' AS provider,
  'answer ' || CAST(o_orderkey AS STRING) AS standup_text,
  CAST(o_orderkey % 101 AS INT) AS quality_score FROM orders"""


@query(
    "daily_digest",
    "commits",
    "commit_files",
    "orders",
    oracle=with_inputs(
        "commits",
        "commit_files",
        tables=q.CAPPED
        | {"kept": q.KEPT}
        | q.digest_tables("kept")
        | {"earlier": _EARLIER.format(sha="sha256", bits="")},
        then="""SELECT author_email, day, commits, repos, digest, fingerprint, hit, reused_text FROM (
  SELECT d.*, e.id IS NOT NULL AS hit, e.standup_text AS reused_text, row_number() OVER (
    PARTITION BY d.author_email, d.day ORDER BY e.created_at DESC, e.id DESC) AS rn
  FROM digests d LEFT JOIN earlier e ON e.commit_hash = d.fingerprint AND e.tone = 'casual'
    AND e.provider = 'local' AND CAST(e.created_at AS DATE) = d.day) WHERE rn = 1""",
    ),
)
def daily_digest(commits, files, orders):
    earlier = orders.selectExpr(
        "o_orderkey AS id",
        "o_orderdate + INTERVAL '20' HOUR AS created_at",
        "sha2(left(md5(CAST(o_orderkey AS STRING)), 7), 256) AS commit_hash",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'formal' ELSE 'casual' END AS tone",
        "'local' AS provider",
        "'answer ' || o_orderkey AS standup_text",
        "CAST(o_orderkey % 101 AS INT) AS quality_score",
    )
    digests = daily.author_days(commits, files)
    return daily.with_reuse(digests, earlier, "casual", "local").select(
        *RUN,
        "commits",
        F.array_join("repos", ", ").alias("repos"),
        "digest",
        "fingerprint",
        "hit",
        "reused_text",
    )
