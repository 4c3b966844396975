"""Answer sections, template variables, template checks and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions.text import col, is_blank, strip


def _section(text: Column, opening: str, closing: str) -> Column:
    gap = rf"[:{rules.SPACE_SET}*]*"
    pattern = (
        rf"(?isud)\*{{0,2}}(?:{opening}){gap}\*{{0,2}}{rules.SPACE}*(.+?)"
        rf"(?=\n{rules.SPACE}*\*{{0,2}}(?:{closing})|$)"
    )
    body = strip(F.replace(strip(F.regexp_extract(text, pattern, 1)), F.lit("*"), F.lit("")))
    return strip(F.regexp_replace(body, rf"^[\[\]]+{rules.SPACE}*", ""))


def sections(text: Column | str) -> Column:
    """Struct of ``yesterday``, ``today``, ``blockers`` found under their headings.

    With neither of the first two, the whole text stands in for ``yesterday``.
    """
    whole = F.coalesce(col(text), F.lit(""))
    plain = F.left(
        strip(F.replace(whole, F.lit("*"), F.lit(""))), F.lit(rules.FALLBACK_SECTION_CHARS)
    )
    named = [_section(whole, opening, closing).alias(n) for n, opening, closing in rules.SECTIONS]

    def settled(found: Column) -> Column:
        nothing = (found["yesterday"] == "") & (found["today"] == "")
        return F.struct(
            F.when(nothing, plain).otherwise(found["yesterday"]).alias("yesterday"),
            found["today"].alias("today"),
            F.when(found["blockers"] == "", "None").otherwise(found["blockers"]).alias("blockers"),
        )

    return _once(F.struct(*named), settled)


def template_variables(
    found: Column | str,
    now: Column | str,
    commit_count: Column | str,
    repos: Column | str,
    provider: Column | str,
    author_email: Column | str,
) -> Column:
    """The nine substitution values as a map; no repositories reads ``n/a``."""
    s = col(found)
    listed = F.when(F.size(F.coalesce(col(repos), F.array())) > 0, F.array_join(col(repos), ", "))
    values = {
        "yesterday": s["yesterday"],
        "today": s["today"],
        "blockers": s["blockers"],
        "date": F.date_format(col(now), "yyyy-MM-dd"),
        "time": F.date_format(col(now), "HH:mm"),
        "commit_count": col(commit_count).cast("string"),
        "repos": F.coalesce(listed, F.lit("n/a")),
        "provider": col(provider).cast("string"),
        "author_email": col(author_email).cast("string"),
    }
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def render(body: Column | str, variables: Column | str) -> Column:
    """Substitute allowed ``{name}`` tokens in one pass; values are not read again.

    The body is cut at its tokens and put together again, because replacing name
    after name would also replace tokens inside values already put in.
    """
    text = F.coalesce(col(body), F.lit(""))
    parts = F.struct(
        col(variables).alias("values"),
        F.split(text, rules.TEMPLATE_TOKEN, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(rules.TEMPLATE_TOKEN), F.lit(1)).alias("names"),
    )

    def put_together(p: Column) -> Column:
        def value(name: Column) -> Column:
            given = F.coalesce(F.try_element_at(p["values"], name), F.lit(""))
            return F.when(
                name.isin(*rules.TEMPLATE_VARIABLES), F.left(given, F.lit(rules.MAX_VALUE_CHARS))
            ).otherwise(F.concat(F.lit("{"), name, F.lit("}")))

        filled = F.transform(p["names"], value)
        return F.array_join(
            F.zip_with(p["pieces"], filled, lambda piece, v: F.concat(piece, F.coalesce(v, F.lit("")))), ""
        )

    return F.left(_once(parts, put_together), F.lit(rules.MAX_RENDERED_CHARS))


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, where it would be copied into each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unsupported_variables(body: Column | str) -> Column:
    """Sorted distinct tokens outside the allowed names."""
    tokens = F.regexp_extract_all(col(body), F.lit(rules.TEMPLATE_TOKEN), F.lit(1))
    allowed = F.array(*[F.lit(v) for v in rules.TEMPLATE_VARIABLES])
    return F.array_sort(F.array_except(tokens, allowed))


def plainly_sound(body: Column | str) -> Column:
    """Whether a short look shows that ``template_error`` finds nothing: every brace belongs to an allowed token."""
    b, names = col(body), "|".join(rules.TEMPLATE_VARIABLES)
    stray = rf"\{{(?!(?:{names})\}})|(?<!\{{(?:{names}))\}}"
    return b.contains("{") & (F.length(b) <= rules.MAX_TEMPLATE_CHARS) & ~b.rlike(stray)


def template_error(body: Column | str) -> Column:
    """First broken rule of a template body, ``''`` when there is none."""
    b = col(body)
    bad = unsupported_variables(b)
    return (
        F.when(b.isNull(), "Template must be a string.")
        .when(is_blank(b), "Template must not be empty.")
        .when(
            F.length(b) > rules.MAX_TEMPLATE_CHARS,
            f"Template must be {rules.MAX_TEMPLATE_CHARS} characters or fewer.",
        )
        .when(b.contains("{{") | b.contains("}}"), "Template must not contain nested braces.")
        .when(
            b.rlike(rules.TEMPLATE_FORBIDDEN),
            "Template must not use Python format specifiers or attribute access.",
        )
        .when(
            ~b.rlike(rules.TEMPLATE_TOKEN),
            "Template must contain at least one valid {variable} placeholder.",
        )
        .when(
            F.size(bad) > 0,
            F.concat(F.lit("Template contains unsupported variables: "), F.array_join(bad, ", ")),
        )
        .otherwise("")
    )
