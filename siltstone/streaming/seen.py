"""Keys that a sink has seen: Bloom filters by bucket and batch, confirmed against the few files that may hold a key."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.session import drop_path, materialize
from siltstone.streaming.buckets import BUCKETS, versions

#: Bits of a filter for each of its keys, and bits that a key sets: about one key in a hundred is looked for in vain.
BITS, HASHES = 10, 7
FILTER = "bucket int, v int, bits binary"


def places(h: np.ndarray, g: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, from two hashes of it."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return (h.view(np.uint64)[:, None] + steps * (g.view(np.uint64) | np.uint64(1))[:, None]) % np.uint64(bits)


def make_filter(h: np.ndarray, g: np.ndarray) -> bytes:
    bits = np.zeros(8 * math.ceil(max(1, len(h)) * BITS / 8), bool)
    bits[places(h, g, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def maybe(bits: bytes, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which keys a filter may hold; a key that it holds is never missed."""
    found = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return found[places(h, g, len(found))].all(axis=1)


class SeenKeys:
    """Rows below ``path`` whose key came for the first time, by batch and bucket, and the filters of their keys. Rows must not have columns ``bucket`` and ``v``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.opened = 0

    def hashed(self, rows: DataFrame) -> DataFrame:
        h = rows.withColumns({"_h": F.xxhash64(self.key), "_g": F.xxhash64(F.lit(1), self.key)})
        return h.withColumn("bucket", F.pmod("_h", F.lit(self.buckets)).cast("int"))

    def known(self, number: int) -> list[int]:
        return [v for v in versions(self.spark, f"{self.path}/rows") if v < number]

    def candidates(self, keys: DataFrame, known: list[int]) -> DataFrame:
        """``(_h, _g, bucket, v)``: the earlier batches that may hold a key, by the filters of its bucket."""
        filters = self.spark.read.schema(FILTER).parquet(*[f"{self.path}/filters/v={v}" for v in known])

        def run(own: pa.Table, some: pa.Table) -> pa.Table:
            h, g = (own.column(c).to_numpy() for c in ("_h", "_g"))
            parts = []
            for bucket, v, bits in zip(*(some.column(c).to_pylist() for c in ("bucket", "v", "bits"))):
                at = maybe(bits, h, g) if len(h) else np.zeros(0, bool)
                n = int(at.sum())
                parts.append(pa.table({"_h": h[at], "_g": g[at], "bucket": pa.array(np.full(n, bucket, np.int32)), "v": pa.array(np.full(n, v, np.int32))}))
            return pa.concat_tables(parts) if parts else pa.table({"_h": pa.array([], pa.int64()), "_g": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "v": pa.array([], pa.int32())})

        return keys.select("_h", "_g", "bucket").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "_h long, _g long, bucket int, v int")

    def put(self, rows: DataFrame, number: int) -> None:
        """Append the rows of a batch whose keys are new; of rows with one key in a batch the one with the least hash stays.

        Only files of buckets and batches that may hold one of the keys are read; which those are, at most as many as there
        are buckets times batches, reaches the driver. A null key is a key. A batch that is done again replaces its own part.
        """
        order = F.xxhash64(*rows.columns)
        first = self.hashed(rows).withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(order))).where("_n = 1").drop("_n")
        kept = f"{self.path}/batch={number}"
        drop_path(self.spark, kept)
        first, known = materialize(first, "seen-batch", kept), self.known(number)
        self.opened = 0
        if known:
            maybe_in = materialize(self.candidates(first, known), "seen-candidates")
            files = [f"{self.path}/rows/v={r.v}/bucket={r.bucket}" for r in maybe_in.select("v", "bucket").distinct().collect()]
            self.opened = len(files)
            if files:
                old = self.spark.read.schema(rows.schema).parquet(*files).select(F.col(self.key).alias("_key"))
                wanted = first.join(maybe_in.select("_h", "_g").distinct(), ["_h", "_g"], "left_semi")
                seen = wanted.join(old, wanted[self.key].eqNullSafe(old["_key"]), "left_semi").select(F.col("_h").alias("_sh"), F.col(self.key).alias("_key"))
                first = first.join(seen, (first["_h"] == seen["_sh"]) & first[self.key].eqNullSafe(seen["_key"]), "left_anti")
        fresh = first.select(*rows.columns, "bucket")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/v={number}")

        def build(key: tuple, own: pa.Table) -> pa.Table:
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([number], pa.int32()), "bits": pa.array([make_filter(*(own.column(c).to_numpy() for c in ("_h", "_g")))], pa.binary())})

        written = self.hashed(self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/v={number}"))
        written.select("bucket", "_h", "_g").groupBy("bucket").applyInArrow(build, FILTER).write.mode("overwrite").parquet(f"{self.path}/filters/v={number}")
        drop_path(self.spark, kept)

    def read(self) -> DataFrame | None:
        """All rows, each key once."""
        known = versions(self.spark, f"{self.path}/rows")
        rows = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/rows")
        return rows.parquet(*[f"{self.path}/rows/v={v}" for v in known]).drop("bucket", "v") if known else None
