"""Approximate nearest vectors: inverted lists around centroids, stored; the lists nearest to a query are scored exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.functions import vectors as vec
from siltstone.session import fresh_path

#: Lists, rows that centroids are fitted on at most, rounds of fitting, parts that each list is dealt to.
LISTS, SAMPLE, ROUNDS, PARTS = 64, 20_000, 10, 4
#: The list of vectors of another width than the centroids, which queries of such widths ask.
OTHER = -1


def unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample; a centroid that loses all its rows stays where it was."""
    rows = unit(sample)
    found = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)]
    for _ in range(rounds):
        near = (rows @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, rows)
        some = np.bincount(near, minlength=len(found)) > 0
        found[some] = unit(sums[some])
    return found


def nearest(df: DataFrame, id_col: str, vector: str, center: np.ndarray, n: int) -> DataFrame:
    """``(list, id, v)``: a row for each of the ``n`` lists whose centroids are nearest; null and empty vectors are left out."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            found = batch.column(1).to_pylist()
            at = [i for i, v in enumerate(found) if len(v) == center.shape[1]]
            lists: list[list[int]] = [[OTHER] for _ in found]
            if at:
                near = np.argsort(-(np.array([found[i] for i in at]) @ center.T), axis=1, kind="stable")[:, :n]
                for i, some in zip(at, near.tolist()):
                    lists[i] = some
            index = pa.array([i for i, some in enumerate(lists) for _ in some], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for some in lists for x in some], pa.int32()), batch.column(0).take(index), batch.column(1).take(index).cast(out.field("v").type)], schema=out)

    return rows.mapInArrow(run, schema)


def in_blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """``(list, <prefix>_ids, <prefix>_width, <prefix>_matrix)``: rows of ``(list, id, v)`` in blocks of one list; long lists are dealt out first."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField(f"{prefix}_ids", T.ArrayType(T.LongType())), T.StructField(f"{prefix}_width", T.IntegerType()), T.StructField(f"{prefix}_matrix", T.BinaryType())])
    dealt = rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("list")

    def run(batches):
        out, held, last = to_arrow_schema(schema), {}, None

        def block(width):
            some = held.pop(width)
            m = np.array([v for _, v in some], np.float64)
            return pa.RecordBatch.from_pylist([{"list": last, f"{prefix}_ids": [i for i, _ in some], f"{prefix}_width": width, f"{prefix}_matrix": m.tobytes()}], schema=out)

        for batch in batches:
            for at, i, v in zip(*(batch.column(c).to_pylist() for c in ("list", "id", "v"))):
                if at != last:
                    yield from [block(w) for w in list(held)]
                    last = at
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield block(len(v))
        yield from [block(w) for w in list(held)]

    return dealt.mapInArrow(run, schema)


@dataclass
class Lists:
    """A stored index: blocks of vectors by list below ``path``, and the centroids."""

    path: str
    center: np.ndarray

    @staticmethod
    def of(vectors: DataFrame, id_col: str, vector: str = "embedding", lists: int = LISTS, sample: int = SAMPLE, path: str | None = None) -> "Lists":
        """Fit the centroids on ``sample`` rows at most, the first by a hash of id and vector, and index every row.

        Nulls and empty vectors are left out. The commonest width of the sample is that of the centroids.
        """
        order = F.xxhash64(id_col, F.col(vector).cast("string"))
        some = [r.v for r in vectors.where(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v"), order.alias("o")).orderBy("o").limit(sample).collect()]
        widths = [len(v) for v in some]
        width = max(sorted(set(widths)), key=widths.count) if widths else 1
        fit = np.array([v for v in some if len(v) == width], np.float64).reshape(-1, width)
        index = Lists(path or fresh_path(vectors.sparkSession, "ann-lists"), centroids(fit, lists) if len(fit) else np.zeros((1, width)))
        index.add(vectors, id_col, vector)
        return index

    def add(self, vectors: DataFrame, id_col: str, vector: str = "embedding") -> None:
        """Index more rows; ids must be new."""
        in_blocks(nearest(vectors, id_col, vector, self.center, 1), vec.BLOCK, "v").write.mode("append").partitionBy("list").parquet(self.path)

    def top_k(self, queries: DataFrame, k: int, probes: int, query_id: str, vector_id: str, query_vector: str = "embedding", digits: int = 6) -> DataFrame:
        """``(query id, vector id, score, rank)``: the ``k`` best by cosine of all vectors in the ``probes`` nearest lists.

        Scores are exact; a near vector in a list that is not probed is missed, so ``probes`` trades recall for work.
        Queries are in blocks by list too, and only lists that some query asks for are read.
        """
        schema = "v_ids array<long>, v_width int, v_matrix binary, list int"
        known = queries.sparkSession.read.schema(schema).parquet(self.path)
        asked = in_blocks(nearest(queries, query_id, query_vector, self.center, probes), vec.QUERIES, "q")
        pairs = known.join(asked, "list").where("q_width = v_width")
        return vec.best_of(pairs, k, query_id, vector_id, digits)


def recall(found: DataFrame, exact: DataFrame, query_id: str, vector_id: str) -> DataFrame:
    """One row: queries, and the share of the exact answers that was found."""
    hit = exact.select(query_id, vector_id).join(found.select(query_id, vector_id).withColumn("_hit", F.lit(1)), [query_id, vector_id], "left")
    return hit.agg(F.count_distinct(query_id).alias("queries"), F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))
