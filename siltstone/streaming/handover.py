"""From a snapshot to the log without a pause: chunks of the table are read while changes go on, between marks in the log.

Before a chunk of the table is read a low mark is written to the log, after it a high mark. The chunk is as old as some moment
between the two, so of its rows those stay whose keys have no change between the marks; where there is one, the change is at
least as new and wins. At the high mark the rest of the chunk goes out as changes of that place in the log. So each key ends
with its last change, chunks may be read in any order at any pace, and a restart goes on with the chunk that was open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from siltstone.session import drop_path
from siltstone.streaming.buckets import Buckets, versions

LOW, HIGH = "low", "high"


def last_mark(marks: DataFrame, kind: str, seq: str) -> DataFrame:
    """``(chunk, <kind>)``: the last mark of one kind of each chunk; a chunk that was begun anew counts from there."""
    return marks.where(F.col("mark") == kind).groupBy("chunk").agg(F.max(seq).alias(kind))


def settled(pending: DataFrame, changes: DataFrame, marks: DataFrame, key: str = "id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """What of the chunks goes out, at the place of its high mark, and what waits on.

    ``pending`` has the rows of chunks with ``chunk`` and ``low``, ``changes`` and ``marks`` are those of the log. A change
    between the marks of its key's chunk, or behind the low mark of one that is open, takes the row away.
    """
    placed = pending.join(last_mark(marks, HIGH, seq), "chunk", "left").withColumn(HIGH, F.when(F.col(HIGH) > F.col(LOW), F.col(HIGH)))
    later = changes.select(F.col(key).alias("_key"), F.col(seq).alias("_at"))
    inside = (F.col(key) == F.col("_key")) & (F.col("_at") > F.col(LOW)) & (F.col(HIGH).isNull() | (F.col("_at") < F.col(HIGH)))
    left = placed.join(later, inside, "left_anti")
    return left.where(F.col(HIGH).isNotNull()).withColumn(seq, F.col(HIGH)).drop("chunk", LOW, HIGH), left.where(F.col(HIGH).isNull()).drop(HIGH)


def follow(stream: DataFrame, table: Buckets, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, columns: list[str]):
    """Start a query that applies a log with marks to ``table``; runs what is there and ends.

    The stream has ``(mark, chunk)``, null for changes, and the columns of changes: key, sequence, ``deleted`` and ``columns``.
    ``chunk`` gets the marks that opened in a batch and returns the rows that were read behind them, with their ``chunk``:
    key and ``columns``. Rows of open chunks are kept below ``path`` by batch.
    """
    key, seq = table.key, table.seq

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        held = f"{path}/log/v={number}"
        rows.write.mode("overwrite").parquet(held)
        rows = spark.read.parquet(held)
        marks = rows.where("mark is not null").select("mark", "chunk", seq)
        changes = rows.where("mark is null").select(key, seq, "deleted", *columns)
        opened = marks.where(F.col("mark") == LOW)
        begun = last_mark(marks, LOW, seq)
        pending = chunk(opened).select("chunk", key, *columns).join(begun, "chunk")
        known = [v for v in versions(spark, f"{path}/open") if v < number]
        if known:  # a chunk that is begun anew replaces what was read of it before
            pending = pending.unionByName(spark.read.parquet(f"{path}/open/v={known[-1]}").join(begun.select("chunk"), "chunk", "left_anti"))
        done, open_ = settled(pending, changes, marks, key, seq)
        open_.write.mode("overwrite").parquet(f"{path}/open/v={number}")
        table.put(changes.unionByName(done.withColumn("deleted", F.lit(False)).select(*changes.columns)), number)
        for old in known[:-1]:
            drop_path(spark, f"{path}/open/v={old}")
        drop_path(spark, held)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
