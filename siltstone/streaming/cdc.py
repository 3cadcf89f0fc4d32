"""Change data capture and task progress as Structured Streaming jobs.

Sinks are keyed tables in hash buckets (see ``buckets``): a batch writes deltas of the buckets it touches, named by the batch, so
a replayed batch overwrites its own files and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions.evolution import json_schemas
from siltstone.operators import tasks
from siltstone.session import drop_path
from siltstone.streaming.buckets import Buckets
from siltstone.streaming.seen import SeenKeys

CHANGE = "id long, seq long, deleted boolean, event_type string, value double"


def changes(spark: SparkSession, path: str, schema: str = CHANGE) -> DataFrame:
    """A folder of JSON lines as a stream; lines that can't be read keep their text in ``_bad``."""
    raw = spark.readStream.text(path).withColumnRenamed("value", "_line")
    parsed = raw.select("_line", F.from_json("_line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("_line", "r.*")
    return parsed.withColumn("_bad", F.when(F.col("_bad").isNotNull() | F.col("id").isNull() | F.col("seq").isNull(), F.col("_line"))).drop("_line")


def kafka_changes(spark: SparkSession, servers: str, topics: str, schema: str = CHANGE) -> DataFrame:
    """The same from Kafka topics, from the earliest offset: the snapshot first, then the log."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "earliest").load()
    return raw.select("topic", F.from_json(F.col("value").cast("string"), schema).alias("r")).select("topic", "r.*")


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a sink that are there."""
    return Buckets(spark, path).read()


def apply_stream(stream: DataFrame, path: str, dead: str, checkpoint: str, key: str = "id", seq: str = "seq"):
    """Start a query that merges every batch into the sink at ``path``; unreadable lines go to ``dead``. Runs what is there and ends.

    Columns that are new in a batch are added to the sink.
    """
    table = Buckets(stream.sparkSession, path, key, seq)

    def batch(rows: DataFrame, number: int) -> None:
        rows.where("_bad is not null").select("_bad").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        table.put(rows.where("_bad is null").drop("_bad"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_of(topic: Column, pattern: str) -> Column:
    """The table that a topic goes to: what the first group of the pattern matches, or null for other topics."""
    name = F.regexp_extract(topic, pattern, 1)
    return F.when(name != "", name)


def apply_topics(stream: DataFrame, path: str, dead: str, checkpoint: str, pattern: str, key: str = "id", seq: str = "seq"):
    """Merge changes of several tables, ``(topic, line)`` with a JSON object a line, each into a sink of its own below ``path``.

    The table is the topic without its prefix (see ``table_of``). Columns and their types are what the objects of a batch
    hold, nested ones too: whole numbers are long, others double, and a type that changes gets one that holds both; a column
    that is new is added to the table, one that is missing is null. Lines without key or sequence, and topics that do not
    match, go to ``dead``. Tables and schemas of a batch reach the driver.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fields = F.from_json("line", f"`{key}` string, `{seq}` string")
        parsed = rows.select("topic", "line", table_of(F.col("topic"), pattern).alias("to"), fields.alias("f"))
        parsed = parsed.withColumn("ok", F.coalesce(F.col("to").isNotNull() & F.col("f")[key].isNotNull() & F.col("f")[seq].try_cast("long").isNotNull(), F.lit(False))).drop("f")
        path_now = f"{dead}/parsed={number}"
        parsed.write.mode("overwrite").partitionBy("to").parquet(path_now)  # each table reads its own lines only
        parsed = spark.read.schema(parsed.schema).parquet(path_now)
        parsed.where("not ok").select("topic", "line").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        for to, schema in json_schemas(parsed.where("ok"), "line", "to").items():
            own = [c for c in schema.names if c not in (seq, "deleted")]
            mine = parsed.where(F.col("ok") & (F.col("to") == to)).select(F.from_json("line", schema).alias("r"), F.get_json_object("line", f"$.{seq}").cast("long").alias(seq), F.coalesce(F.get_json_object("line", "$.deleted").try_cast("boolean"), F.lit(False)).alias("deleted"))
            Buckets(spark, f"{path}/{to}", key, seq).put(mine.select(*[F.col("r")[c].alias(c) for c in own], seq, "deleted"), number)
        drop_path(spark, path_now)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Append rows whose key the sink has not seen (see ``SeenKeys``); runs what is there and ends."""
    sink = SeenKeys(stream.sparkSession, path, key)
    return stream.writeStream.foreachBatch(sink.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    return SeenKeys(spark, path, "").read()


def progress(steps: DataFrame, task: str = "id", stages: int = tasks.STAGES) -> DataFrame:
    """Steps done, percent and last kind of step of each task; works on streams in update or complete mode."""
    counts = steps.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", "seq").alias("last"))
    return counts.withColumn("percent", tasks.percent(F.col("n"), stages))


