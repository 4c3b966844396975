"""Text hygiene: trimming, cleaning, capping, redaction, masking and size texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space (Spark's one-argument ``trim`` only takes spaces)."""
    return F.trim(col(c), F.lit(rules.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def subject_line(message: Column | str) -> Column:
    """First line of the trimmed message, at most 500 characters; blank gives ``''``."""
    first = F.regexp_extract(strip(message), f"^{rules.NOT_LINE_BREAK}*", 0)
    return F.coalesce(F.left(first, F.lit(rules.MAX_MESSAGE_CHARS)), F.lit(""))


def clean_text(c: Column | str, max_chars: int = rules.MAX_MESSAGE_CHARS) -> Column:
    """Drop NUL, trim, fold runs of two or more spaces (only spaces), cap."""
    no_nul = F.translate(col(c), "\0", "")
    return F.left(F.regexp_replace(strip(no_nul), " {2,}", " "), F.lit(max_chars))


def storage_clean(c: Column | str) -> Column:
    """Drop NUL, turn CRLF and CR into LF, cap at the stored length."""
    no_nul = F.translate(col(c), "\0", "")
    return F.left(F.regexp_replace(no_nul, "\r\n?", "\n"), F.lit(rules.MAX_STORED_CHARS))


def response_cap(c: Column | str) -> Column:
    return F.left(col(c), F.lit(rules.MAX_RESPONSE_CHARS))


def response_truncated(c: Column | str) -> Column:
    return F.length(col(c)) > rules.MAX_RESPONSE_CHARS


# --- redaction ---------------------------------------------------------------


def _has_clue(text: Column, low: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    def one_of(words: tuple[str, ...]) -> Column:
        tests = [low.contains(w[1:]) if w.startswith("~") else text.contains(w) for w in words]
        return reduce(lambda a, b: a | b, tests)

    return reduce(lambda a, b: a & b, [one_of(g) for g in groups])


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def redact(c: Column | str) -> Column:
    """Replace secrets and internal network names in a short text, rule after rule.

    One nested expression, so it fits inside a printed line.  For long texts use
    ``redact_counted``, which skips the rules a text holds no clue for.
    """
    text = col(c)
    for replacement, pattern in rules.REDACTIONS:
        text = F.regexp_replace(text, pattern, _literal(replacement))
    return text


def redact_counted(c: Column | str) -> Column:
    """Struct with the redacted ``text`` and its number of ``hits``.

    A rule counts its hits on the text the rules before it left, so each step needs
    the last step's result several times.  The one-element array gives that result a
    name; written out instead, ten steps would grow into millions of terms as soon as
    someone filters on the outcome.

    A rule runs only where the text held its literal clue at the start (a replacement
    never brings a new one), so ordinary text costs a few byte searches and no
    pattern matching; a replacement is made only where there was a hit.
    """
    named = F.array(F.struct(col(c).alias("text"), F.lower(col(c)).alias("low")))

    def begin(s: Column) -> Column:
        clues = [_has_clue(s["text"], s["low"], groups) for groups in rules.REDACTION_CLUES]
        return F.struct(
            s["text"].alias("text"), F.lit(0).alias("hits"), F.array(*clues).alias("clues")
        )

    state = F.transform(named, begin)
    for rule, (replacement, pattern) in enumerate(rules.REDACTIONS):
        state = F.transform(state, _counting(rule, pattern))
        state = F.transform(state, _replacing(pattern, _literal(replacement)))
    return F.get(state, F.lit(0))


def _counting(rule: int, pattern: str):
    def step(s: Column) -> Column:
        found = F.regexp_count(s["text"], F.lit(pattern))
        found = F.when(F.get(s["clues"], F.lit(rule)), found).otherwise(0)
        parts = [s[name].alias(name) for name in ("text", "hits", "clues")]
        return F.struct(*parts, found.alias("found"))

    return step


def _replacing(pattern: str, replacement: str):
    def step(s: Column) -> Column:
        changed = F.regexp_replace(s["text"], pattern, replacement)
        return F.struct(
            F.when(s["found"] > 0, changed).otherwise(s["text"]).alias("text"),
            (s["hits"] + s["found"]).alias("hits"),
            s["clues"].alias("clues"),
        )

    return step


def error_clean(message: Column | str, error_class: Column | str | None = None) -> Column:
    """User-facing text of an error: fixed sentence per known class, else scrubbed and capped."""
    text = strip(message)
    for pattern in rules.ERROR_REDACTIONS:
        text = F.regexp_replace(text, pattern, _literal(rules.REDACTED))
    text = strip(F.regexp_replace(text, f"{rules.SPACE}+", " "))
    short = F.concat(
        F.rtrim(F.left(text, F.lit(rules.MAX_ERROR_CHARS)), F.lit(rules.WHITESPACE)), F.lit("...")
    )
    body = (
        F.when(is_blank(message), rules.UNEXPECTED_ERROR)
        .when(F.length(text) > rules.MAX_ERROR_CHARS, short)
        .otherwise(text)
    )
    if error_class is None:
        return body
    known = F.lit(None).cast("string")
    for name, sentence in reversed(rules.ERROR_SENTENCES):
        known = F.when(col(error_class) == name, sentence).otherwise(known)
    return F.coalesce(known, body)


# --- keys, sizes, words ------------------------------------------------------


def mask_key(c: Column | str) -> Column:
    key = col(c)
    masked = F.concat(
        F.left(key, F.lit(10)), F.repeat(F.lit("*"), F.length(key) - 14), F.right(key, F.lit(4))
    )
    return F.when(F.length(key) >= 14, masked).otherwise("****")


def key_format_ok(c: Column | str) -> Column:
    key = col(c)
    ok = key.startswith(rules.API_KEY_PREFIX) & (F.length(key) >= rules.API_KEY_MIN_CHARS)
    return F.coalesce(ok, F.lit(False))


def size_text(n_bytes: Column | str) -> Column:
    """Bytes as ``B``, ``KB`` (one decimal) or ``MB`` (two), exact ties to even."""
    n = col(n_bytes)
    kb, mb = F.bround(n / 1024.0, 1), F.bround(n / 1048576.0, 2)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", kb))
        .otherwise(F.format_string("%.2f MB", mb))
    )


def size_band(n_bytes: Column | str) -> Column:
    n = col(n_bytes)
    return (
        F.when(n > rules.FAIL_SIZE_BYTES, "fail")
        .when(n > rules.WARN_SIZE_BYTES, "warn")
        .otherwise("pass")
    )


def parse_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(clean_text(c)).isin(*rules.TRUE_WORDS), F.lit(False))


def parse_int(c: Column | str) -> Column:
    """Whole number written in a text, or null; decimals and exponents are not numbers."""
    text = strip(col(c).cast("string"))
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(text.rlike(rules.INTEGER), digits.try_cast("decimal(38,0)"))
