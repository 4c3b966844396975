"""Settings: resolving layered values and validating whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.settings import settings_errors, with_messages, with_values
from daybook.operators.joins import apart

SECRET_LAYERS_FROM = 2  # keychain and environment rows count only when they hold a value


def resolve(layers: DataFrame, scope: str = "scope") -> DataFrame:
    """Effective value per scope and dotted key; the highest layer wins, null included.

    A plain value set above a block removes the block, and a block set above a plain
    value removes the value: rows are checked against every part of their own path.
    """
    held = (F.col("layer") < SECRET_LAYERS_FROM) | (F.coalesce("value", F.lit("")) != "")
    latest = (
        layers.filter(held)
        .groupBy(scope, "key")
        .agg(F.max_by(F.struct("value"), "layer").alias("_value"), F.max("layer").alias("_layer"))
    )
    parts = F.split("key", r"\.")
    path = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")
    )
    spread = latest.withColumn("_path", F.explode(path))
    own = F.col("_path") == F.col("key")
    at_path = (
        spread.groupBy(scope, "_path", apart([scope, "_path"]))
        .agg(
            F.max(F.when(own, F.col("_layer"))).alias("_as_value"),
            F.max(F.when(~own, F.col("_layer"))).alias("_as_block"),
        )
        .drop("_apart")
    )
    over = F.when(own, F.col("_as_block")).otherwise(F.col("_as_value"))
    return (
        spread.join(at_path, [scope, "_path"])
        .groupBy(scope, "key")
        .agg(
            F.first("_value").alias("_value"),
            F.first("_layer").alias("layer"),
            F.max(over).alias("_over"),
        )
        .filter(F.coalesce(F.col("_over") <= F.col("layer"), F.lit(True)))
        .select(scope, "key", F.col("_value.value").alias("value"), "layer")
    )


def dealt(documents: DataFrame, tasks: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows dealt evenly over ``tasks``, by default the session's number of shuffle partitions.

    A rule book costs far more per row than moving the row, and a table of small rows is few splits
    (one row group is one task however many rows it has).  ``tasks=0`` leaves the rows where they are, as
    do streams, whose triggers are small.  Rows are dealt in turn, which Spark sorts them for, or by the hash
    of the columns ``by``, without a sort; these must be as good as unique, as equal values meet in one task.
    """
    if tasks == 0 or documents.isStreaming:
        return documents
    spark = documents.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return documents.repartition(tasks or least, *by)


def validate(documents: DataFrame, document: str = "settings", tasks: int | None = None) -> DataFrame:
    """Settings documents with ``errors`` and ``is_valid``, judged in ``tasks`` tasks (see ``dealt``).

    The document is JSON text or a variant; text that is no JSON object is an error.
    """
    documents = dealt(documents, tasks)
    doc = F.col(document)
    if documents.schema[document].dataType.typeName() == "string":
        doc = F.try_parse_json(doc)
    held, values = with_values(documents.withColumn("_doc", doc), "_doc")
    held, messages = with_messages(held, values)
    errors = F.when(values[""].is_object(), settings_errors(messages)).otherwise(
        F.array(F.lit("settings must be a JSON object."))
    )
    judged = held.select(*documents.columns, errors.alias("errors"))
    return judged.withColumn("is_valid", F.size("errors") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest for quarantine."""
    return validated.filter("is_valid"), validated.filter("not is_valid")
