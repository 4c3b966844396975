"""Template tables: built-in bodies, names, lookup and rendering of answers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook import rules
from daybook.functions import templating as ft
from daybook.functions.text import response_cap
from daybook.operators.times import moment

GENERATOR = "the digest job"


def builtin_bodies(generator: str = GENERATOR) -> dict[str, str]:
    return {
        name: body.replace("%(generator)s", generator) for name, body in rules.BUILTIN_TEMPLATES
    }


def _builtin_body(name: Column, bodies: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in bodies.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), name)


def look_up(
    requests: DataFrame,
    custom: DataFrame,
    scope: Sequence[str] = (),
    bodies: dict[str, str] | None = None,
) -> DataFrame:
    """Each request with its template body and a status: ok, invalid or missing.

    ``custom`` holds ``name`` and ``body`` (one row per scope and name) and shadows the
    built-in bodies; an invalid custom body is an error, never a fallback.  The built-in
    bodies are a constant of the plan, not a table to join.
    """
    own = custom.select(
        *scope,
        F.col("name").alias("template"),
        F.col("body").alias("_own"),
        ft.template_error("body").alias("_problem"),
    )
    joined = requests.join(own, [*scope, "template"], "left")
    found = _builtin_body(F.col("template"), bodies or builtin_bodies())
    status = (
        F.when(F.col("_problem") == "", "ok")
        .when(F.col("_problem").isNotNull(), "invalid")
        .when(found.isNotNull(), "ok")
        .otherwise("missing")
    )
    body = F.when(
        F.col("_problem") == "", F.left("_own", F.lit(rules.MAX_TEMPLATE_CHARS))
    ).when(F.col("_problem").isNull(), found)
    return joined.withColumns(
        {"body": body, "status": status, "problem": F.coalesce("_problem", F.lit(""))}
    ).drop("_own", "_problem")


def names(custom: DataFrame, bodies: dict[str, str] | None = None) -> DataFrame:
    """All template names with their kind; a name in the custom set is ``Custom``."""
    spark = custom.sparkSession
    known = list(bodies or builtin_bodies())
    builtin = spark.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in known])).alias("name"), F.lit(0).alias("own")
    )
    both = builtin.union(custom.select("name", F.lit(1).alias("own")))
    kind = F.when(F.max("own") == 1, "Custom").otherwise("Built-in")
    return both.groupBy("name").agg(kind.alias("kind"))


def render_answers(answers: DataFrame, now: datetime | str) -> DataFrame:
    """Rendered output of answers that already carry a template body.

    Needs ``response``, ``body``, ``commits``, ``repos``, ``provider`` and
    ``author_email``.  The response is capped, cut into sections and put into the body.
    """
    found = answers.withColumn("_sections", ft.sections(response_cap("response")))
    when = F.lit(moment(now).isoformat(sep=" ")).cast("timestamp_ntz")
    variables = ft.template_variables(
        "_sections", when, "commits", "repos", "provider", "author_email"
    )
    return (
        found.withColumn("_variables", variables)
        .withColumn("output", ft.render("body", "_variables"))
        .drop("_sections", "_variables")
    )
