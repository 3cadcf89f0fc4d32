"""A keyed table on shared storage, in hash buckets with base and delta files.

A batch of changes is reduced to the last change of each key and written as a delta of the buckets that its keys fall into;
nothing else is touched, so what a batch writes follows the batch and not the table. Readers take a bucket's base and the
deltas behind it and merge them; buckets without deltas are read as they are. Compaction merges a bucket that has gathered many
deltas into a new base, and only that one. All files of a batch bear its number, so a batch that is replayed overwrites its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions.evolution import widened
from siltstone.operators import reconcile
from siltstone.session import drop_path

BUCKETS, DELTAS = 16, 4


def folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers behind ``prefix`` of the folders below ``path``."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below ``path``."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [v for v in folders(spark, path, "v=") if fs.exists(path_of(f"{path}/v={v}/_SUCCESS"))]


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(base).getLength() if fs.exists(base) else 0


class Buckets:
    """The table below ``path``. Deleted keys stay known, so late changes do not bring them back.

    ``buckets`` is fixed when the table is made: a bucket should be what one task can sort. ``deltas`` is how many deltas a
    bucket gathers before it is compacted. Columns that are new in a batch are added, and a column whose type changes gets one that
    holds both (see ``evolution``); keys must not be null.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", seq: str = "seq", buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.path, self.key, self.seq, self.buckets, self.deltas = spark, path, key, seq, buckets, deltas

    def layout(self) -> tuple[dict[int, int], dict[int, list[int]]]:
        """The base version of each bucket, and the versions of its deltas that are newer. Both are as many as there are buckets and open deltas."""
        base: dict[int, int] = {}
        for v in versions(self.spark, f"{self.path}/base"):
            base |= dict.fromkeys(folders(self.spark, f"{self.path}/base/v={v}", "bucket="), v)
        deltas: dict[int, list[int]] = {}
        for v in versions(self.spark, f"{self.path}/delta"):
            for b in folders(self.spark, f"{self.path}/delta/v={v}", "bucket="):
                if v > base.get(b, -1):
                    deltas.setdefault(b, []).append(v)
        return base, deltas

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/v={number}")

    def _read(self, paths: list[tuple[int, str]]) -> DataFrame | None:
        """Files by version, which have one schema each, as one table."""
        by_version: dict[int, list[str]] = {}
        for v, path in paths:
            by_version.setdefault(v, []).append(path)
        frames = [self.spark.read.parquet(*some) for some in by_version.values()]
        return reduce(DataFrame.unionByName, widened(frames)) if frames else None

    def _rows(self, base: dict[int, int], deltas: dict[int, list[int]], some: list[int]) -> DataFrame | None:
        """The last change of each key of some buckets."""
        rows = self._read([(base[b], f"{self.path}/base/v={base[b]}/bucket={b}") for b in some if b in base])
        new = self._read([(v, f"{self.path}/delta/v={v}/bucket={b}") for b in some for v in deltas.get(b, ())])
        if rows is None or new is None:
            return reconcile.latest(new, self.key, self.seq) if rows is None and new is not None else rows
        return reconcile.merge(*widened([rows, new]), self.key, self.seq, "deleted")

    def put(self, changes: DataFrame, number: int) -> None:
        """Write a batch; then compact the buckets that have enough deltas. Files that were of no use before this batch are deleted."""
        self._clean()
        self._write(reconcile.latest(changes, self.key, self.seq), "delta", number)
        base, deltas = self.layout()
        worn = [b for b, some in deltas.items() if len(some) >= self.deltas]
        if worn:
            self._write(self._rows(base, deltas, worn), "base", number)

    def _clean(self) -> None:
        base, deltas = self.layout()
        used = {v for some in deltas.values() for v in some}
        for kind, live in (("base", set(base.values())), ("delta", used)):
            for v in versions(self.spark, f"{self.path}/{kind}"):
                if v not in live:
                    drop_path(self.spark, f"{self.path}/{kind}/v={v}")

    def stored(self) -> DataFrame | None:
        """The last change of each key, deleted ones too; None before the first row."""
        base, deltas = self.layout()
        whole, open_ = self._rows(base, {}, [b for b in base if b not in deltas]), self._rows(base, deltas, list(deltas))
        if whole is None or open_ is None:
            return open_ if whole is None else whole
        return reduce(DataFrame.unionByName, widened([whole, open_]))

    def read(self) -> DataFrame | None:
        """The rows that are there."""
        rows = self.stored()
        return reconcile.present(rows) if rows is not None and "deleted" in rows.columns else rows
