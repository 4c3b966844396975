"""Commit expressions: type, noise, changed path, module, printed line, prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions.text import col, is_blank, redact, strip


def classify(message: Column | str) -> Column:
    """Commit type key: a conventional prefix wins, then the first matching hint."""
    return classify_trimmed(strip(message))


def classify_trimmed(text: Column | str) -> Column:
    """``classify`` for a message already trimmed; on a column of its own, it is trimmed once."""
    text = col(text)
    prefix = F.lower(F.regexp_extract(text, rules.CONVENTIONAL_PREFIX, 1))
    out = F.when(F.coalesce(text, F.lit("")) == "", rules.UNKNOWN_TYPE).when(prefix != "", prefix)
    for name, pattern in rules.TYPE_HINTS:
        out = out.when(text.rlike("(?iu)" + pattern), name)
    return out.otherwise(rules.UNKNOWN_TYPE)


def is_noise(message: Column | str) -> Column:
    """Blank messages and the eight low-signal forms."""
    pattern = "(?iu)" + "|".join(f"(?:{p})" for p in rules.NOISE)
    return is_blank(message) | strip(message).rlike(pattern)


def type_attribute(type_key: Column | str, position: int) -> Column:
    """Emoji (1) or label (2) of a type key; unknown keys read the ``unknown`` entry."""
    pairs = [F.lit(x) for entry in rules.COMMIT_TYPES for x in (entry[0], entry[position])]
    fallback = dict((e[0], e[position]) for e in rules.COMMIT_TYPES)[rules.UNKNOWN_TYPE]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(type_key)), F.lit(fallback))


def changed_path(a_path: Column | str, b_path: Column | str) -> Column:
    """New path, else old path; null when neither names a file."""
    return F.coalesce(F.nullif(col(b_path), F.lit("")), F.nullif(col(a_path), F.lit("")))


def path_module(path: Column | str) -> Column:
    """Second part of a path with three parts or more, else the first part.

    Empty and ``.`` parts do not count, and a leading slash is a part of its own.
    Ordinary paths take the first branch, which needs no pattern and no array.
    """
    p = col(path)
    odd = (
        p.startswith("/")
        | p.startswith("./")
        | p.endswith("/")
        | p.endswith("/.")
        | p.contains("//")
        | p.contains("/./")
        | p.isin("", ".")
    )
    first_two = F.substring_index(p, "/", 2)
    ordinary = F.when(first_two != p, F.substring_index(first_two, "/", -1)).otherwise(
        F.substring_index(p, "/", 1)
    )
    tidy = F.regexp_replace(F.regexp_replace(p, r"^\.$|(?<=/|^)(?:\./|/)|/\.$", ""), "/$", "")
    names = F.split(tidy, "/")
    root = F.when(p.rlike("^//(?!/)"), "//").otherwise("/")
    absolute = F.when(F.size(names) >= 2, F.get(names, F.lit(0))).otherwise(root)
    relative = F.get(names, F.when(F.size(names) >= 3, 1).otherwise(0))
    return (
        F.when(~odd, ordinary)
        .when(p.startswith("/"), absolute)
        .otherwise(F.nullif(relative, F.lit("")))
    )


def modules(paths: Column | str) -> Column:
    """Sorted distinct modules of an array of paths."""
    named = F.transform(col(paths), path_module)
    return F.array_sort(F.array_distinct(F.filter(named, lambda m: m.isNotNull())))


def minute_text(ts: Column | str, tz_offset_min: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm`` in the commit's own UTC offset."""
    local = F.timestamp_add("MINUTE", col(tz_offset_min), col(ts))
    return F.date_format(local, "yyyy-MM-dd HH:mm")


def files_preview(first_paths: Column | str, n_files: Column | str, shown: int = 5) -> Column:
    """Up to five paths and how many more there are; ``''`` without files."""
    n = col(n_files)
    head = F.array_join(F.slice(col(first_paths), 1, shown), ", ")
    more = F.concat(F.lit(" (+"), (n - shown).cast("string"), F.lit(" more)"))
    return F.coalesce(F.concat(head, F.when(n > shown, more).otherwise("")), F.lit(""))


def commit_line(
    minute: Column | str,
    type_key: Column | str,
    emoji: Column | str,
    message: Column | str,
    preview: Column | str,
    insertions: Column | str,
    deletions: Column | str,
) -> Column:
    """One digest line: time, type, redacted message, files and line counts."""

    def or_empty(c):
        return F.coalesce(col(c), F.lit(""))

    mark = F.when(or_empty(emoji) != "", F.concat(col(emoji), F.lit(" "))).otherwise("")
    head = strip(
        F.concat(
            F.lit("- ["),
            F.right(or_empty(minute), F.lit(5)),
            F.lit("] "),
            mark,
            F.lit("("),
            F.coalesce(col(type_key), F.lit(rules.UNKNOWN_TYPE)),
            F.lit(") "),
            redact(or_empty(message)),
        )
    )
    files = F.when(or_empty(preview) != "", F.concat(F.lit(" -> files: "), col(preview)))
    counts = F.concat(
        F.lit(" (+"),
        F.coalesce(col(insertions), F.lit(0)).cast("string"),
        F.lit("/-"),
        F.coalesce(col(deletions), F.lit(0)).cast("string"),
        F.lit(")"),
    )
    return F.concat(head, F.coalesce(files, F.lit("")), counts)


def summary_line(commits: Column, insertions: Column, deletions: Column, names: Column) -> Column:
    """Closing digest line with totals and the sorted module names."""
    listed = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("n/a")
    return F.concat(
        F.lit("SUMMARY: "),
        commits.cast("string"),
        F.lit(" commit(s), +"),
        insertions.cast("string"),
        F.lit("/-"),
        deletions.cast("string"),
        F.lit(" lines, modules: "),
        listed,
    )


def prompt_text(digest: Column | str, tone: Column | str) -> Column:
    """Digest wrapped in the fixed request; any tone but casual is formal."""
    manner = F.when(col(tone) == "casual", rules.PROMPT_CASUAL).otherwise(rules.PROMPT_FORMAL)
    return F.concat(
        F.lit(rules.PROMPT_OPENING),
        col(digest),
        F.lit(rules.PROMPT_REQUEST),
        manner,
        F.lit(rules.PROMPT_LAYOUT),
    )


def retry_prompt(prompt: Column | str, issues: Column | str) -> Column:
    """Prompt for another attempt: one bullet per issue, then the first request."""
    bullets = F.array_join(F.transform(col(issues), lambda x: F.concat(F.lit("- "), x)), "\n")
    guidance = F.when(F.size(F.coalesce(col(issues), F.array())) > 0, bullets)
    return F.concat(
        F.lit(rules.RETRY_OPENING),
        F.coalesce(guidance, F.lit(rules.RETRY_DEFAULT)),
        F.lit(rules.RETRY_ORIGINAL),
        col(prompt),
    )


def lookback_hours(week: Column | str, hours: Column | str, configured: Column | str) -> Column:
    """168 for a week, else explicit non-zero hours, else the setting, else 24."""
    chosen = F.coalesce(
        F.nullif(col(hours), F.lit(0)), col(configured), F.lit(rules.DEFAULT_LOOKBACK_HOURS)
    )
    return F.when(F.coalesce(col(week), F.lit(False)), rules.WEEK_HOURS).otherwise(chosen)
