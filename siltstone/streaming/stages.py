"""Logs of staged tasks as a stream with state: steps in order of time, each task's log ending at its first failure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators import tasks

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = "task_id long, ts timestamp, id long, stage string, status string"
#: A step that waits: its time in microseconds; an id that is null is the least one.
WAITING, NO_ID = "at long, id long, stage string, status string", -(1 << 63)


class StageLog(StatefulProcessor):
    """State of a task: steps that wait for the watermark, how many went out, and whether one of them failed.

    A timer of event time stands at the last step of every batch; when the watermark has passed it nothing earlier can come any
    more, so all steps up to the watermark go out in order. Behind a failure the task is over: what waits is dropped, and so is
    all that comes later, in whichever batch.
    """

    def __init__(self, stages: int):
        self.stages = stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.done = handle.getValueState("done", "n long, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = pd.isna(key[0]) or self.done.exists() and self.done.get()[1]
        last = None
        for some in rows:
            if over or some.empty:
                continue
            self.waiting.appendList([(int(t), int(i), s, w) for t, i, s, w in zip(some["at"], some["id"], some["stage"], some["status"])])
            last = max(int(some["at"].max()), last if last is not None else NO_ID)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        steps = sorted(self.waiting.get(), key=lambda x: (x[0], x[1])) if self.waiting.exists() else []
        n, failed = self.done.get() if self.done.exists() else (0, False)
        out, left = [], []
        for at, i, stage, status in steps:
            if failed:
                break
            if at >= now * 1000:
                left.append((at, i, stage, status))
                continue
            n, failed = n + 1, status == "FAIL"
            out.append((key[0], None if i == NO_ID else i, stage, status, n, min(100, int(n * 100 / self.stages + 0.5))))
        self.waiting.clear()
        if left and not failed:
            self.waiting.put(left)
        self.done.update((n, failed))
        if out:
            yield pd.DataFrame(out, columns=["task_id", "id", "stage", "status", "n", "percent"])

    def close(self) -> None:
        pass


def until_failure(steps: DataFrame, delay: str, stages: int = tasks.STAGES) -> DataFrame:
    """Streaming form of ``tasks.until_failure``: ``(task_id, id, stage, status, n, percent)``, each step once and final.

    ``steps`` is a stream of ``(task_id, ts, id, stage, status)``. A step may come up to ``delay`` of event time late, in any
    batch; later ones are dropped, as is usual with watermarks. Steps of one time go by id. Rows without a task only move the
    watermark (a heartbeat), rows without a time are left out. Steps wait until the watermark has passed them, so a log ends with a heartbeat later than
    ``delay`` behind its last step. State of a task is what waits, a count and a flag; it is kept, because a failed task
    must stay over. The state store must be RocksDB, see ``start``.
    """
    out = T.StructType([steps.schema["task_id"], *[T.StructField(c, t) for c, t in (("id", T.LongType()), ("stage", T.StringType()), ("status", T.StringType()), ("n", T.LongType()), ("percent", T.IntegerType()))]])
    timed = steps.where("ts is not null").select("task_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "stage", "status").withWatermark("ts", delay)
    return timed.groupBy("task_id").transformWithStateInPandas(StageLog(stages), out, "append", "eventTime")


def start(rows: DataFrame, path: str, checkpoint: str):
    """Append the rows of a stream with state to files below ``path``, each once; runs what is there and ends."""
    conf = rows.sparkSession.conf
    had = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:  # a query keeps the settings it started with
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(STORE, had) if had else conf.unset(STORE)
