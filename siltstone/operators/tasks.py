"""Task analytics: suggestions, steps and patches summed up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

STAGES = 6


@dataclass
class Handler:
    """Makes patches of one kind of unit. All but the name are columns over the unit's row; ``error`` is null where nothing is wrong."""

    name: str
    can_handle: Column
    patched: Column
    rationale: Column
    confidence: Column
    needs_review: Column
    error: Column


def dispatch(units: DataFrame, handlers: list[Handler], keep: list[str]) -> DataFrame:
    """``(*keep, handler, patched, rationale, confidence, needs_review)``: each unit goes to the first handler that takes it.

    A unit that no handler takes gives no row (see ``unhandled``). Where a handler meets an error the row has no patch,
    confidence 0, needs review and says so.
    """

    def first(pick: Callable[[Handler], Column]) -> Column:
        return F.coalesce(*[F.when(h.can_handle, F.struct(pick(h).alias("v"))) for h in handlers])["v"]

    wrong = first(lambda h: h.error.cast("string"))
    rows = units.where(reduce(lambda a, b: a | b, [F.coalesce(h.can_handle, F.lit(False)) for h in handlers], F.lit(False)))
    return rows.select(
        *keep, first(lambda h: F.lit(h.name)).alias("handler"), F.when(wrong.isNull(), first(lambda h: h.patched)).alias("patched"), F.when(wrong.isNull(), first(lambda h: h.rationale)).otherwise(F.concat(F.lit("handler error: "), wrong)).alias("rationale"),
        F.when(wrong.isNull(), first(lambda h: h.confidence)).otherwise(0.0).alias("confidence"), F.when(wrong.isNull(), first(lambda h: h.needs_review)).otherwise(True).alias("needs_review"),
    )


def unhandled(units: DataFrame, handlers: list[Handler]) -> DataFrame:
    """The units that no handler takes."""
    return units.where(~reduce(lambda a, b: a | b, [F.coalesce(h.can_handle, F.lit(False)) for h in handlers], F.lit(False)))


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A row for each wanted key, with ``error`` where there is none."""
    found = rows.withColumn("_there", F.lit(True))
    return wanted.join(found, key, "left").withColumn("error", F.when(F.col("_there").isNull(), "not found")).drop("_there")


def patch_set(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean confidence (0 without patches) and how many need review."""
    return patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.round(F.avg("confidence"), 6), F.lit(0.0)).alias("mean_confidence"), F.count_if(F.col("needs_review")).alias("review"))


def stage_metrics(steps: DataFrame, by: str) -> DataFrame:
    """Steps, times, failures, tokens and mean confidence of each stage."""
    return steps.groupBy(by).agg(F.sum("tokens").alias("tokens"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count(F.lit(1)).alias("steps"), F.round(F.avg("elapsed"), 6).alias("mean_elapsed"), F.max("elapsed").alias("max_elapsed"), F.count_if(F.col("status") == "FAIL").alias("failed"))


def outcomes(steps: DataFrame, task: str) -> DataFrame:
    """success if all steps went well, else partial."""
    return steps.groupBy(task).agg(F.count(F.lit(1)).alias("steps"), F.when(F.bool_and(F.col("status") == "OK"), "success").otherwise("partial").alias("outcome"))


def until_failure(steps: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Each task's steps up to and with its first failure."""
    before = Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("_f", F.max(F.col("status") == "FAIL").over(before)).where(~F.coalesce("_f", F.lit(False))).drop("_f")


def percent(done: Column, stages: int = STAGES) -> Column:
    return F.least(F.lit(100), F.floor(done * 100 / stages + 0.5)).cast("int")


def daily(df: DataFrame, ts: str, name: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias(name))


def on_every_day(counts: DataFrame, name: str) -> DataFrame:
    """The counts on a calendar without gaps; days without rows have 0. The calendar comes from the first and last day."""
    spine = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(counts, "day", "left").select("day", F.coalesce(name, F.lit(0)).alias(name))


def share(df: DataFrame, by: str) -> DataFrame:
    """Count of each value and its share of all."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row for each value
