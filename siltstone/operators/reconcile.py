"""Reconciliation of a source table and its copy, casts on the way, and change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def row_parity(source: DataFrame, target: DataFrame) -> DataFrame:
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(source, "source").unionByName(count(target, "target"))


def except_diff(target: DataFrame, source: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The first ``limit`` distinct rows that only the target has."""
    return target.subtract(source).orderBy(*order).limit(limit)


def range_profile(df: DataFrame, digits: int = 6) -> DataFrame:
    """``(column_name, low, high, mean)`` of every numeric column, from one pass."""
    names = [n for n, t in df.dtypes if t.split("(")[0] in NUMERIC]
    row = df.agg(*[f(F.col(n).cast("double")).alias(f"{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max), ("mean", F.avg))])
    parts = [F.struct(F.lit(n).alias("column_name"), F.col(f"low_{n}").alias("low"), F.col(f"high_{n}").alias("high"), F.round(f"mean_{n}", digits).alias("mean")) for n in names]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def difference(source: DataFrame, target: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """One row: counts, missing, extra and changed keys, and whether the counts lie within ``tolerance``."""
    rest = [c for c in source.columns if c != key]
    digest = lambda df, name: df.select(key, F.xxhash64(*rest).alias(name))
    both = digest(source, "a").withColumn("_s", F.lit(1)).join(digest(target, "b").withColumn("_t", F.lit(1)), key, "full")
    row = both.agg(
        F.count("_s").alias("source_rows"), F.count("_t").alias("target_rows"), F.count_if(F.col("_t").isNull()).alias("missing"), F.count_if(F.col("_s").isNull()).alias("extra"), F.count_if(F.col("a") != F.col("b")).alias("changed"),
    )
    delta = F.abs(F.col("source_rows") - F.col("target_rows")) / F.greatest("source_rows", F.lit(1))
    return row.withColumn("row_delta", F.round(delta, 6)).withColumn("within", delta < tolerance)


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of both sides with their types; null where a side lacks one. Decimals have precision and scale of their own too."""
    spark = source.sparkSession
    catalog = lambda df, name: spark.createDataFrame(df.dtypes, f"column_name string, {name} string")
    both = catalog(source, "source_type").join(catalog(target, "target_type"), "column_name", "full")
    part = lambda side, g: F.nullif(F.regexp_extract(f"{side}_type", r"^decimal\((\d+),(\d+)\)", g), F.lit("")).cast("int")
    parts = {f"{side}_{name}": part(side, g) for side in ("source", "target") for g, name in ((1, "precision"), (2, "scale"))}
    return both.withColumn("same", F.col("source_type").eqNullSafe(F.col("target_type"))).withColumns(parts)


#: Type of the target for a type of the source.
TYPE_MAP = {"NUMBER": "decimal(20,4)", "DATE": "timestamp", "CLOB": "string", "BLOB": "binary", "TINYINT(1)": "boolean"}


def cast_rule(value: Column, source_type: str) -> Column:
    """A value of the source as the target holds it: zero dates become null, tinyint(1) boolean; what can't be cast is null."""
    target = TYPE_MAP[source_type.upper()]
    if target == "timestamp":
        return F.when(~F.startswith(value.cast("string"), F.lit("0000-00-00")), value.cast("string").try_cast("timestamp"))
    if target == "boolean":
        return value.try_cast("int") != 0
    return value.try_cast(target)


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last change of each key."""
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    return changes.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def merge(target: DataFrame, changes: DataFrame, key: str, seq: str, deleted: str) -> DataFrame:
    """Apply changes by key: the latest of each key wins if it is newer than what the target knows of the key.

    The target keeps ``deleted`` and the sequence with each row, so a deleted key stays known and neither a replayed batch
    nor an older change that comes late brings it back; ``present`` hides such rows. A key without a sequence counts as
    oldest. New columns of the changes are added to the target.
    """
    both = target.withColumn("_of", F.lit(1)).unionByName(changes.withColumn("_of", F.lit(0)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc_nulls_last(seq), F.desc("_of"))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_of")


def present(rows: DataFrame, deleted: str = "deleted") -> DataFrame:
    """The rows that are not deleted, without the mark."""
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
