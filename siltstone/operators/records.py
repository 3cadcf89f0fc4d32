"""Structured records that break a rule: set aside with what is wrong with them, and looked at again when rules or records change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions.evolution import widened
from siltstone.session import materialize


def quarantine(rows: DataFrame, errors: Column, path: str, number: int = 0) -> DataFrame:
    """The rows without errors; the others are kept below ``path`` as ``(record, errors)`` of batch ``number``.

    ``errors`` is a list of names or messages, empty or null for a good row. A record is JSON, so batches of different
    schemas lie in one table; a batch that is done again replaces its own part.
    """
    checked = rows.withColumn("_errors", F.coalesce(errors, F.array().cast("array<string>")))
    checked = materialize(checked, "records-checked")  # rules are evaluated once for both sides
    bad = checked.where(F.size("_errors") > 0)
    bad.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("record"), F.col("_errors").alias("errors")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return checked.where(F.size("_errors") == 0).drop("_errors")


def held(spark: SparkSession, path: str) -> DataFrame:
    """``(record, errors, batch)`` of all that is set aside."""
    return spark.read.schema("record string, errors array<string>, batch int").parquet(path)


def summary(held_rows: DataFrame) -> DataFrame:
    """``(error, n, first_batch)``: how many records break each rule; one with several errors counts for each."""
    return held_rows.select("batch", F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("first_batch"))


def retry(held_rows: DataFrame, schema: str, errors: Column, path: str, number: int) -> DataFrame:
    """Parse what is set aside again and check it by other rules; what passes is returned, the rest is set aside below ``path``."""
    return quarantine(held_rows.select(F.from_json("record", schema).alias("r")).select("r.*"), errors, path, number)


def together(good: list[DataFrame]) -> DataFrame:
    """Good rows of several batches as one table; types that differ are widened."""
    out, *more = widened(good)
    for df in more:
        out = out.unionByName(df)
    return out
