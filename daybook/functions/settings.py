"""Checks of one settings document held as a VARIANT column.

Settings arrive as JSON with any type in any place, and several rules are about
types, so the checks read the variant itself rather than a typed struct.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions.templating import plainly_sound, template_error
from daybook.functions.text import is_blank, parse_int, strip

MISSING = object()


def setting(found: Column, default=MISSING) -> Column:
    """A key's value; the default stands in only where the key is absent, not for null."""
    if default is MISSING:
        return found
    return F.coalesce(found, F.parse_json(F.lit(json.dumps(default))))


@dataclass(frozen=True)
class Value:
    """A JSON value with its kind, its text and, where asked for, its whole number.

    Blocks and lists that rules look into have their entries instead, which are null where the value
    is of another type; naming the kind of a block would walk all that is in it.
    """

    raw: Column
    kind: Column | None = None
    text: Column | None = None
    number: Column | None = None
    entries: Column | None = None

    def is_object(self) -> Column:
        return self.kind.startswith("OBJECT") if self.entries is None else self.entries.isNotNull()

    def is_list(self) -> Column:
        return self.kind.startswith("ARRAY") if self.entries is None else self.entries.isNotNull()

    def is_text(self) -> Column:
        return self.kind == "STRING"


def value_of(raw: Column) -> Value:
    return Value(raw, F.coalesce(F.schema_of_variant(raw), F.lit("VOID")), raw.try_cast("string"))


def printed(value: Value) -> Column:
    """The value as printed text."""
    return (
        F.when(value.kind == "VOID", "None")
        .when(value.kind == "BOOLEAN", F.initcap(value.text))
        .when(value.is_object() | value.is_list(), F.to_json(value.raw))
        .otherwise(value.text)
    )


def quoted(value: Value) -> Column:
    """The value as it is shown in a message: texts in quotes."""
    text = value.text
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    shown = F.when(text.contains("'") & ~text.contains('"'), double).otherwise(single)
    return F.when(value.is_text(), shown).otherwise(printed(value))


def whole(value: Value) -> Column:
    """Whole number of a JSON value, null where it has none; fractions are cut off."""
    number = value.text.try_cast("decimal(38,6)")
    return (
        F.when(value.is_text(), parse_int(value.text))
        .when(value.kind == "BOOLEAN", F.when(value.text == "true", 1).otherwise(0))
        .when(
            value.kind.rlike("INT|DECIMAL|DOUBLE|FLOAT"),
            F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)),
        )
        .cast("decimal(38,0)")
    )


def is_empty(value: Value) -> Column:
    """Null, ``""``, false, 0, ``[]`` or ``{}``."""
    return (
        F.when(value.kind == "VOID", True)
        .when(value.is_text(), value.text == "")
        .when(value.kind == "BOOLEAN", value.text == "false")
        .when(value.is_object() | value.is_list(), F.to_json(value.raw).isin("[]", "{}"))
        .otherwise(value.text.try_cast("double") == 0)
    )


def whole_or_zero(value: Value) -> Column:
    """Like ``whole``, but empty values count as 0."""
    return F.when(is_empty(value), F.lit(0).cast("decimal(38,0)")).otherwise(whole(value))


def message_when(bad: Column, *parts: Column | str) -> Column:
    texts = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.when(F.coalesce(bad, F.lit(False)), F.concat(*texts))


def joined(errors: list[Column], prefix: str) -> Column:
    """One message out of a block's messages, null when the block is clean."""
    text = F.concat(F.lit(prefix), F.concat_ws(" | ", *errors))
    return F.when(F.coalesce(*errors).isNotNull(), text)


def _names(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def boolean_error(value: Value, name: str) -> Column:
    return message_when(value.kind != "BOOLEAN", f"{name} must be a boolean.")


def range_error(value: Value, name: str, low: int, high: int) -> Column:
    """Not a whole number, or outside the range."""
    number = value.number
    return F.coalesce(
        message_when(number.isNull(), f"{name} must be an integer, got: ", quoted(value)),
        message_when((number < low) | (number > high), f"{name} must be between {low} and {high}."),
    )


def hours_error(value: Value) -> Column:
    number = value.number
    return F.coalesce(
        message_when(number.isNull(), "hours_lookback must be an integer, got: ", quoted(value)),
        message_when(
            (number < 1) | (number > rules.MAX_LOOKBACK_HOURS),
            f"hours_lookback must be between 1 and {rules.MAX_LOOKBACK_HOURS}, got: ",
            number.cast("string"),
        ),
    )


def email_error(value: Value) -> Column:
    empty = value.is_text() & (value.text == "")
    return message_when(
        ~empty & ~printed(value).rlike(rules.EMAIL),
        "author_email: Invalid email format: ",
        quoted(value),
    )


def tone_error(value: Value) -> Column:
    return F.coalesce(
        message_when(~value.is_text(), "tone: tone must be a string, got: ", type_word(value)),
        message_when(
            ~F.lower(strip(value.text)).isin(*rules.TONES),
            f"tone: tone must be one of {_names(rules.TONES)}, got: ",
            quoted(value),
        ),
    )


def type_word(value: Value) -> Column:
    k = value.kind
    return (
        F.when(k == "VOID", "NoneType")
        .when(k == "BOOLEAN", "bool")
        .when(k.startswith("ARRAY"), "list")
        .when(k.startswith("OBJECT"), "dict")
        .when(k == "STRING", "str")
        .when(k.contains("INT"), "int")
        .otherwise("float")
    )


def webhook_error(value: Value) -> Column:
    empty = value.is_text() & (value.text == "")
    return message_when(
        ~empty & ~printed(value).startswith(rules.WEBHOOK_PREFIX),
        f"slack_webhook_url: slack_webhook_url must start with '{rules.WEBHOOK_PREFIX}', got: ",
        quoted(value),
    )


def rate_limit_messages(v: dict[str, Value]) -> list[Column]:
    return [
        boolean_error(v["rate_enabled"], "rate_limit.enabled"),
        range_error(v["cooldown"], "rate_limit.cooldown_minutes", 0, 1440),
        range_error(v["max_calls"], "rate_limit.max_calls_per_day", 1, 50),
    ]


def rate_limit_error(v: dict[str, Value], inside: list[Column]) -> Column:
    return F.when(
        ~v["rate_limit"].is_object(), "rate_limit: rate_limit must be a JSON object."
    ).otherwise(joined(inside, "rate_limit: "))


def quality_messages(v: dict[str, Value]) -> list[Column]:
    return [
        boolean_error(v["quality_enabled"], "quality.enabled"),
        boolean_error(v["show_breakdown"], "quality.show_breakdown"),
        range_error(v["min_score"], "quality.min_score", 0, 100),
    ]


def quality_error(v: dict[str, Value], inside: list[Column]) -> Column:
    return F.when(
        ~v["quality"].is_object(), "quality: quality must be a JSON object."
    ).otherwise(joined(inside, "quality: "))


def provider_messages(v: dict[str, Value]) -> list[Column]:
    local, cloud, key = v["ollama"], v["groq"], v["api_key"]

    def model_error(owner: Value, model: Value, label: str) -> Column:
        bad = ~model.is_text() | is_blank(model.text)
        return message_when(
            owner.is_object() & bad, f"provider.{label}.model must be a non-empty string."
        )

    key_bad = ~key.is_text() | ~key.text.startswith(rules.API_KEY_PREFIX)
    return [
        message_when(~local.is_object(), "provider.ollama must be a JSON object."),
        message_when(
            local.is_object() & ~printed(v["base_url"]).rlike(rules.BASE_URL),
            "provider.ollama.base_url must be a valid URL, got: ",
            quoted(v["base_url"]),
        ),
        model_error(local, v["ollama_model"], "ollama"),
        message_when(~cloud.is_object(), "provider.groq must be a JSON object."),
        model_error(cloud, v["groq_model"], "groq"),
        message_when(
            cloud.is_object() & ~is_empty(key) & key_bad,
            "provider.groq.api_key must start with 'gsk_' when provided.",
        ),
    ]


def provider_error(v: dict[str, Value], inside: list[Column]) -> Column:
    name = v["provider_name"]
    unknown = message_when(
        ~(name.is_text() & name.text.isin(*rules.PROVIDERS)),
        f"provider: provider.name must be one of {_names(rules.PROVIDERS)}, got: ",
        quoted(name),
    )
    return F.when(
        ~v["provider"].is_object(), "provider: provider must be a JSON object."
    ).otherwise(F.coalesce(unknown, joined(inside, "provider: ")))


def template_name_error(value: Value, custom: Value) -> Column:
    own = F.coalesce(F.map_keys(custom.entries), F.array())
    builtin = F.array(*[F.lit(name) for name, _ in rules.BUILTIN_TEMPLATES])
    available = F.array_union(builtin, own.cast("array<string>"))
    shown = F.array_join(
        F.transform(F.array_sort(available), lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "
    )
    return F.coalesce(
        message_when(
            ~value.is_text() | is_blank(value.text),
            "template: template must be a non-empty string.",
        ),
        message_when(
            ~F.array_contains(available, value.text),
            "template: template must be one of [",
            shown,
            "], got: ",
            quoted(value),
        ),
    )


def custom_templates_error(block: Value) -> Column:
    def read(e: Column) -> Column:
        body = F.when(F.schema_of_variant(e["value"]) == "STRING", e["value"].try_cast("string"))
        return F.struct(e["key"].alias("key"), body.alias("body"))

    def one(e: Column) -> Column:
        named = e["key"].rlike(rules.TEMPLATE_NAME)
        problem = template_error(e["body"])
        broken = F.coalesce(
            message_when(
                ~named,
                "custom_templates keys must use letters, numbers, underscores, "
                "or dashes (max 50 chars).",
            ),
            message_when(problem != "", "custom_templates.", e["key"], F.lit(": "), problem),
        )
        return F.when(~F.coalesce(named & plainly_sound(e["body"]), F.lit(False)), broken)

    found = F.array_compact(F.transform(F.transform(F.map_entries(block.entries), read), one))
    return (
        F.when(
            ~block.is_object(), "custom_templates: custom_templates must be a JSON object."
        )
        .when(
            F.size(block.entries) > rules.MAX_CUSTOM_TEMPLATES,
            f"custom_templates: custom_templates must contain at most "
            f"{rules.MAX_CUSTOM_TEMPLATES} templates.",
        )
        .when(
            F.size(found) > 0,
            F.concat(F.lit("custom_templates: "), F.array_join(found, " | ")),
        )
    )


def repos_errors(value: Value) -> Column:
    """One message per bad entry.

    Entries are looked at one by one only where the list as text leaves a doubt: there every entry that
    opens with a quote and a visible ASCII character other than a quote is a text that is not blank.
    """
    listed = F.to_json(value.raw)
    doubt = listed.contains("\\") | listed.rlike(r'(?:^\[|,)(?!"[!#-~])')

    def one(v: Column) -> Column:
        bad = (F.schema_of_variant(v) != "STRING") | is_blank(v.try_cast("string"))
        return message_when(
            F.coalesce(bad, F.lit(True)), "repos: each entry must be a non-empty string."
        )

    return F.when(~value.is_list(), F.array(F.lit("repos must be a JSON array."))).when(
        F.coalesce(doubt, F.lit(True)), F.array_compact(F.transform(value.entries, one))
    ).otherwise(F.array().cast("array<string>"))


# name: path, value where the key is absent; a block stands before its keys
SETTINGS = {
    "repos": ("repos", []),
    "email": ("author_email", ""),
    "hours": ("hours_lookback", 24),
    "tone": ("tone", "casual"),
    "webhook": ("slack_webhook_url", ""),
    "provider": ("provider", {}),
    "provider_name": ("provider.name", ""),
    "ollama": ("provider.ollama", {}),
    "base_url": ("provider.ollama.base_url", ""),
    "ollama_model": ("provider.ollama.model", ""),
    "groq": ("provider.groq", {}),
    "groq_model": ("provider.groq.model", ""),
    "api_key": ("provider.groq.api_key", ""),
    "rate_limit": ("rate_limit", {}),
    "rate_enabled": ("rate_limit.enabled", MISSING),
    "cooldown": ("rate_limit.cooldown_minutes", MISSING),
    "max_calls": ("rate_limit.max_calls_per_day", MISSING),
    "quality": ("quality", {"enabled": True, "min_score": 0, "show_breakdown": False}),
    "quality_enabled": ("quality.enabled", MISSING),
    "show_breakdown": ("quality.show_breakdown", MISSING),
    "min_score": ("quality.min_score", MISSING),
    "template": ("template", "default"),
    "custom": ("custom_templates", {}),
    "noise_filter": ("noise_filter_enabled", True),
    "auto_warm_up": ("auto_warm_up", False),
}
NUMBERS = {
    "hours": whole,
    "cooldown": whole_or_zero,
    "max_calls": whole_or_zero,
    "min_score": whole_or_zero,
}
ENTRIES = {"repos": "array<variant>", "custom": "map<string,variant>"}
# several rules in one message
BLOCKS = {
    "provider": (provider_messages, provider_error),
    "rate_limit": (rate_limit_messages, rate_limit_error),
    "quality": (quality_messages, quality_error),
}


def _members(path: str) -> dict[str, str]:
    """Names of the settings right below a block, by key."""
    parted = {n: where.rpartition(".") for n, (where, _) in SETTINGS.items()}
    return {key: n for n, (parent, _, key) in parted.items() if parent == path}


def _opened(out: DataFrame, blocks: dict[str, str]) -> DataFrame:
    """The keys of the named blocks (name: path) in columns, each block read in one pass."""
    keys = {n: _members(path) for n, path in blocks.items()}
    out = out.withColumns(
        {
            f"_{n}_entries": F.col(f"_{n}").try_cast(
                "struct<" + ", ".join(f"{key}: variant" for key in found) + ">"
            )
            for n, found in keys.items()
        }
    )
    return out.withColumns(
        {
            f"_{name}": setting(F.col(f"_{n}_entries")[key], SETTINGS[name][1])
            for n, found in keys.items()
            for key, name in found.items()
        }
    )


def with_values(documents: DataFrame, doc: str) -> tuple[DataFrame, dict[str, Value]]:
    """Read every setting once into columns of its own, for rules that use it many times.

    Of ``doc`` itself only ``entries`` are given, under the empty name.
    """
    out, level, opened = documents.withColumn("_", F.col(doc)), {"": ""}, []
    while level:
        out = _opened(out, level)
        opened += level
        below = [n for block in level.values() for n in _members(block).values()]
        level = {n: SETTINGS[n][0] for n in below if _members(SETTINGS[n][0])}
    entries = {f"_{n}_entries": F.col(f"_{n}").try_cast(kind) for n, kind in ENTRIES.items()}
    plain = [n for n in SETTINGS if n not in opened and n not in ENTRIES]
    facts = {}
    for n in plain:
        value = value_of(F.col(f"_{n}"))
        facts |= {f"_{n}_kind": value.kind, f"_{n}_text": value.text}
    out = out.withColumns(facts | entries)
    values = {n: Value(F.col(f"_{n}"), entries=F.col(f"_{n}_entries")) for n in [*opened, *ENTRIES]}
    values |= {n: Value(F.col(f"_{n}"), F.col(f"_{n}_kind"), F.col(f"_{n}_text")) for n in plain}
    out = out.withColumns({f"_{n}_number": number(values[n]) for n, number in NUMBERS.items()})
    values |= {n: replace(values[n], number=F.col(f"_{n}_number")) for n in NUMBERS}
    return out, values


def with_messages(held: DataFrame, v: dict[str, Value]) -> tuple[DataFrame, list[Column]]:
    """Every rule's message in a column of its own, in field order; null where the rule is kept.

    Array functions with a lambda interpret all that is written inside them, so they are given columns.
    The messages of ``repos``, one per entry, are a list in the column ``_repos_messages``.
    """
    held = held.withColumn("_repos_messages", repos_errors(v["repos"]))
    single = {
        "email": email_error(v["email"]),
        "hours": hours_error(v["hours"]),
        "tone": tone_error(v["tone"]),
        "webhook": webhook_error(v["webhook"]),
        "template": template_name_error(v["template"], v["custom"]),
        "custom": custom_templates_error(v["custom"]),
        "noise_filter": boolean_error(v["noise_filter"], "noise_filter_enabled"),
        "auto_warm_up": boolean_error(v["auto_warm_up"], "auto_warm_up"),
        "n_repos": message_when(
            F.size(v["repos"].entries) > rules.MAX_REPOS,
            f"repos must contain at most {rules.MAX_REPOS} entries.",
        ),
        "n_custom": message_when(
            F.size(v["custom"].entries) > rules.MAX_CUSTOM_TEMPLATES,
            f"custom_templates must contain at most {rules.MAX_CUSTOM_TEMPLATES} entries.",
        ),
    }
    inside = {
        block: {f"_{block}_message_{i}": m for i, m in enumerate(messages(v))}
        for block, (messages, _) in BLOCKS.items()
    }
    out = held.withColumns({f"_{n}_message": m for n, m in single.items()})
    out = out.withColumns({n: m for found in inside.values() for n, m in found.items()})
    out = out.withColumns(
        {
            f"_{block}_message": whole_block(v, [F.col(n) for n in inside[block]])
            for block, (_, whole_block) in BLOCKS.items()
        }
    )
    m = {n: F.col(f"_{n}_message") for n in [*single, *BLOCKS]}
    fields = [m["email"], F.concat(F.lit("hours_lookback: "), m["hours"]), m["tone"], m["webhook"], *(m[b] for b in BLOCKS)]
    rest = ["template", "custom", "noise_filter", "auto_warm_up", "n_repos", "n_custom", "hours"]
    return out, [*fields, *(m[n] for n in rest)]


def settings_errors(messages: list[Column]) -> Column:
    """All messages of a settings document, in field order; empty when it is valid."""
    found = F.when(F.coalesce(*messages).isNull(), F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(*messages))
    )
    return F.concat(F.col("_repos_messages"), found)


def argument_errors(
    hours: Column,
    week: Column,
    command: Column,
    clear: Column,
    limit: Column,
    slack: Column | None = None,
    webhook: Column | None = None,
) -> Column:
    """Messages about options that exclude each other or need another one."""
    found = [
        message_when(
            (F.coalesce(hours, F.lit(0)) != 0) & week, "--hours and --week are mutually exclusive."
        )
    ]
    if slack is not None:
        found.append(
            message_when(
                slack & (F.coalesce(webhook, F.lit("")) == ""),
                "--slack requires slack_webhook_url to be set in config.",
            )
        )
    found.append(
        message_when(
            (command == "history") & clear & limit.isNotNull() & (limit != 10),
            "--limit cannot be combined with history --clear.",
        )
    )
    return F.array_compact(F.array(*found))


def bounded_int_error(value: Column, name: str, low: int = 1, high: int = 200) -> Column:
    """Message for an argument that is no whole number of the range, ``''`` when fine."""
    number = parse_int(value)
    shown = F.concat(F.lit("'"), value, F.lit("'"))
    found = F.coalesce(
        message_when(number.isNull(), f"{name} must be an integer, got: ", shown),
        message_when((number < low) | (number > high), f"{name} must be between {low} and {high}."),
    )
    return F.coalesce(found, F.lit(""))


