"""The topic catalog as a log of requests: creation is idempotent, settings are validated, deleted topics may come again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators.frontier import policy_error

SETTINGS = ["ack", "factor", "ord", "sequencer"]


def answered(requests: DataFrame) -> DataFrame:
    """requests(topic, at, action: create or delete, ack, factor, ord, sequencer) with `answer`.

    CREATED, EXISTS (same settings), CONFLICT (other ones), DELETED, UNKNOWN, or what is wrong with the settings. A topic
    lives from its first valid creation to the next deletion.
    """
    by = Window.partitionBy("topic").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    error = policy_error(*(F.col(c) for c in SETTINGS))
    rows = requests.withColumn("_life", F.coalesce(F.sum((F.col("action") == "delete").cast("int")).over(by), F.lit(0)))
    good = (F.col("action") == "create") & error.isNull()
    first = F.min(F.when(good, F.struct("at", *SETTINGS))).over(Window.partitionBy("topic", "_life"))
    rows = rows.withColumns({"_first": first, "_error": error})
    same = F.struct(*SETTINGS) == F.struct(*(F.col(f"_first.{c}").alias(c) for c in SETTINGS))
    created = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("at") == F.col("_first.at"), "CREATED").when(same, "EXISTS").otherwise("CONFLICT")
    deleted = F.when(F.col("_first").isNotNull(), "DELETED").otherwise("UNKNOWN")
    return rows.withColumn("answer", F.when(F.col("action") == "create", created).otherwise(deleted)).drop("_life", "_first", "_error")


def alive(answers: DataFrame) -> DataFrame:
    """The topics that exist after all requests, with their settings."""
    last = answers.groupBy("topic").agg(F.max(F.when(F.col("answer") == "DELETED", F.col("at"))).alias("_gone"), F.max(F.when(F.col("answer") == "CREATED", F.struct("at", *SETTINGS))).alias("_c"))
    return last.where("_c is not null and (_gone is null or _gone < _c.at)").select("topic", *(f"_c.{c}" for c in SETTINGS))
