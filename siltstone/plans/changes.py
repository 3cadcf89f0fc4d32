"""Queries over change logs that come in several batches: bucketed sinks, hand-over from snapshot to log, stage logs with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.operators import tasks
from siltstone.plans import boards, migration
from siltstone.session import fresh_path, table
from siltstone.streaming import cdc, handover, stages
from siltstone.streaming.buckets import Buckets

SLICES, CHUNKS = 4, 4


def slices(df: DataFrame, by: str, n: int) -> DataFrame:
    """Add ``_slice`` from 0 to ``n - 1`` by equal ranges of a whole number."""
    span = df.agg(F.min(by).alias("_a"), F.max(by).alias("_b"))
    rows = df.join(F.broadcast(span), how="cross")  # one row
    return rows.withColumn("_slice", F.floor((F.col(by) - F.col("_a")) * n / (F.col("_b") - F.col("_a") + 1)).cast("int")).drop("_a", "_b")


def cdc_batches(spark, sf_dir):
    """The events as changes in several runs of one stream, each started anew; buckets are compacted on the way."""
    path, out, dead, log = (fresh_path(spark, n) for n in ("changes", "cdc-buckets", "dead", "cdc-log"))
    rows = slices(migration.changes(spark, sf_dir), "seq", 6).withColumn("_slice", (F.col("_slice") * 5 + 3) % 6)  # batches do not come in order
    for i in range(6):
        rows.where(F.col("_slice") == i).select(F.to_json(F.struct("id", "seq", "deleted", "event_type", "value"))).write.mode("append").text(path)
        cdc.apply_stream(cdc.changes(spark, path), out, dead, log).awaitTermination()
    return cdc.snapshot(spark, out).select("id", "seq", "event_type", "value")


def cdc_typed(spark, sf_dir):
    """Changes of one table whose columns are long, double and nested; a number gets a fraction and the nested one a field later."""
    path, out, dead, log = (fresh_path(spark, n) for n in ("typed", "typed-table", "dead", "typed-log"))
    rows = migration.changes(spark, sf_dir).withColumn("late", F.col("seq") % 2)
    early = F.struct("id", "seq", F.floor("value").cast("long").alias("amount"), F.struct(F.col("event_type").alias("kind")).alias("at"))
    late = F.struct("id", "seq", F.col("value").alias("amount"), F.struct(F.col("event_type").alias("kind"), F.array("seq", "id").alias("path")).alias("at"))
    for i, shape in ((0, early), (1, late)):
        rows.where(F.col("late") == i).select(F.lit("app.src.db.typed").alias("topic"), F.to_json(shape).alias("line")).write.mode("append").json(path)
        cdc.apply_topics(spark.readStream.schema("topic string, line string").json(path), out, dead, log, r"^app\.src\.db\.(.*)$").awaitTermination()
    found = cdc.snapshot(spark, f"{out}/typed")
    types = {f.name: f.dataType.simpleString() for f in found.schema}
    return found.select("id", "seq", F.round("amount", 6).alias("amount"), F.col("at.kind").alias("kind"), F.get("at.path", 0).alias("first"), F.lit(types["amount"]).alias("amount_type"), F.lit(types["id"]).alias("id_type"))


def snapshot_then_log(spark, sf_dir):
    """Users' last events as a table that changes while it is read in chunks; the log is kept from a tenth of its length on."""
    log_path, chunk_path, out, own, cp = (fresh_path(spark, n) for n in ("marked-log", "chunks", "handover", "handover-own", "handover-log"))
    rows = migration.changes(spark, sf_dir)
    last = rows.agg(F.max("seq").alias("m")).first()["m"] or 0
    at = lambda share: int(last * share)
    marks = [(m, c, at(0.2 + 0.15 * c + d)) for c in range(CHUNKS) for m, d in ((handover.LOW, 0.0), (handover.HIGH, 0.12))]
    # what a chunk's reader sees lies between its marks: the rows as of some place there
    chunk = F.pmod(F.xxhash64("id"), F.lit(CHUNKS)).cast("long")
    seen = rows.withColumn("chunk", chunk).where(F.col("seq") <= F.lit(at(0.26)) + F.floor(F.col("chunk") * (0.15 * last)))
    then = seen.groupBy("chunk", "id").agg(F.max_by(F.struct("deleted", "event_type", "value"), "seq").alias("r")).select("chunk", "id", "r.*").where("not deleted")
    then.select("chunk", "id", "event_type", "value").write.partitionBy("chunk").parquet(chunk_path)
    read = spark.read.schema("id long, event_type string, value double, chunk long").parquet(chunk_path)
    kept = rows.where(F.col("seq") >= at(0.1)).select(F.lit(None).cast("string").alias("mark"), F.lit(None).cast("long").alias("chunk"), "id", (F.col("seq") * 2).alias("seq"), "deleted", "event_type", "value")
    signs = spark.createDataFrame([(m, c, None, 2 * s + 1, None, None, None) for m, c, s in marks], kept.schema)
    log = slices(kept.unionByName(signs), "seq", SLICES)
    sink = Buckets(spark, out)
    for i in range(SLICES):
        log.where(F.col("_slice") == i).drop("_slice").write.mode("append").json(log_path)
        stream = spark.readStream.schema(kept.schema).json(log_path)
        handover.follow(stream, sink, lambda opened: read.join(F.broadcast(opened.select("chunk").distinct()), "chunk"), own, cp, ["event_type", "value"]).awaitTermination()  # as many as chunks begin in a batch
    return sink.read().select("id", "event_type", "value")


def stage_log(spark, sf_dir):
    """Steps of tasks as a stream in several runs; a tenth of them comes a run late."""
    path, out, cp = (fresh_path(spark, n) for n in ("steps", "stage-log", "stage-checkpoint"))
    steps = boards.steps(spark, sf_dir).select("task_id", "ts", "id", "stage", "status")
    span = steps.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.unix_timestamp(F.max("ts")).alias("e"), F.unix_timestamp(F.min("ts")).alias("s")).first()
    seconds = max(1, ((span["e"] or 0) - (span["s"] or 0)) // SLICES + 1)
    rows = steps.withColumn("_slice", F.least(F.floor((F.unix_timestamp("ts") - (span["s"] or 0)) / seconds) + F.when(F.col("id") % 10 == 3, 1).otherwise(0), F.lit(SLICES - 1)))
    beat = spark.createDataFrame([(None, span["b"], None, None, None)], stages.STEPS).withColumn("ts", F.col("ts") + F.expr(f"make_dt_interval(0, 0, 0, {6 * seconds})"))
    for i in range(SLICES + 1):
        (rows.where(F.col("_slice") == i).drop("_slice") if i < SLICES else beat).write.mode("append").parquet(path)
        stages.start(stages.until_failure(spark.readStream.schema(stages.STEPS).parquet(path), f"{2 * seconds} seconds"), out, cp).awaitTermination()
    return spark.read.parquet(out)


QUERIES = {f.__name__: f for f in (cdc_batches, cdc_typed, snapshot_then_log, stage_log)}

ORACLES = {
    "cdc_batches": f"with {migration.LATEST} select id, seq, event_type, value from c where not deleted",
    "cdc_typed": "select user_id id, max(event_id) seq, round(arg_max(case when event_id % 2 = 0 then floor(value) else value end, event_id), 6) amount, arg_max(event_type, event_id) kind, case when max(event_id) % 2 = 1 then max(event_id) end \"first\", 'double' amount_type, 'bigint' id_type from events group by user_id",
    "snapshot_then_log": f"with {migration.LATEST} select id, event_type, value from c where not deleted",
    "stage_log": f"""with {boards.P}, r as (select *, row_number() over (partition by task_id order by ts, id) n, coalesce(count(*) filter (status = 'FAIL') over (partition by task_id order by ts, id rows between unbounded preceding and 1 preceding), 0) f from p)
        select task_id, id, stage, status, n, least(100, floor(n * 100 / {tasks.STAGES} + 0.5))::INT percent from r where f = 0""",
}
